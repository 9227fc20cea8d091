"""Several values packed in one field.

A parsing expression grammar reads the field. Its alternatives are ordered and the first that fits
wins, so a malformed quote, bracket or parenthesis goes back to the next alternative, which takes the mark by itself
and flags it. Each rule is a function of a position that gives the position after what it took, or -1.

    field    <- SP ( bracket / list ) SP
    bracket  <- '[' SP quote ( SP ','? SP quote )* SP ','? SP ']' SP !.
    quote    <- '"' ( '\\' . / !'"' . )* '"' / "'" ( '\\' . / !( "'" SP ( [,'] / ']' / !. ) ) . )* "'"
    list     <- ( separator / and / affil / item / mark / run / . )*
    item     <- double &( SP ( affil SP )? ( separator / [,&'"] / ']' / 'and' / !. ) )
    double   <- '"' ( '\\' . / !'"' . )* '"'
    affil    <- '(' ( affil / !')' . )* ')', to any depth, and the same of wide parentheses
    separator <- [;|\\n\\r\\t] / wide ';' / ideographic ',' / S [/·] S
    and      <- SP '&' SP / S+ 'and' S+, unless the subject of an organisation goes on
    mark     <- a quote or parenthesis without its other half, flagged
    run      <- ( !S !special . )+

The comma is a separator of the list, except where it stands inside one name written with the family
name first: a single word (or the rest of an organisation's name) before it, given names after it.
'and' and '&' are no separators inside the subject of an organisation ("Center for Search and Planning"), nor between
a word and itself ("Johnson and Johnson").
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from quirelake.functions.missing import PLACEHOLDERS

_WS = " \t\n\r\x0b\x0c\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
_RUN = re.compile(r"[^()（）\"；;、|&,，/·\s]+")
_SPACE = re.compile(r"\s+")
_DOUBLE = re.compile(r'"(?:\\.|[^"\\])*"', re.S)
_SINGLE = re.compile(r"'(?:\\.|[^'\\]|'(?!\s*(?:[,\]']|$)))*'", re.S)
_EASY = re.compile(r"^[^\"'“”‘’\[\]()（）&|,，；、/·\n\r\t\\{}]*$")
# without the marks that need the grammar: quotes, parentheses, '&' and 'and'
_LISTED = re.compile(r"^[^\"()（）&]*$")
_AND = re.compile(r"\sand\s")
_STRONG = re.compile(r"[;|\n\r\t；、]|\s[/·]\s")
_COMMA = re.compile(r"[,，]")
_SUBJECT = re.compile(r"\b(?:of|for|on)\s+[\w-]+$", re.I)
_HEAD = re.compile(r"^(?:the\s+)?(?:[\w.]+\s+){0,2}(?:of|for|on)\s+\w+", re.I)
_SUFFIX = re.compile(r"^(?:jr|sr|ii|iii|iv|ph\.?d|md)\.?$", re.I)
_INITIAL = re.compile(r"^(?:[^\W\d_]\.?-?){1,3}\.?$")
_PAIRS = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}

QUOTE, BRACKET, EMPTY, PARENS = 1, 2, 4, 8


def _family_first(left: str, right: str) -> bool:
    """Whether the comma between the pieces stands inside one name."""
    if _SUFFIX.match(right):
        return True
    words = left.split()
    if not words or not right:
        return False
    if len(words) == 1:
        return not _INITIAL.match(left) or len(left.strip(".")) > 2 or bool(_INITIAL.match(right))
    return bool(_HEAD.match(left)) and len(right.split()) == 1


def _names(chunk: str) -> list[str]:
    """Names of one chunk between the strong separators."""
    if "," not in chunk and "，" not in chunk:
        return [chunk]
    pieces = [p.strip(_WS) for p in _COMMA.split(chunk)]
    at = [m.end() for m in _COMMA.finditer(chunk)]
    starts = [0, *at]
    ends = [x - 1 for x in at] + [len(chunk)]
    out, i = [], 0
    while i < len(pieces):
        if i + 1 < len(pieces) and pieces[i] and _family_first(pieces[i], pieces[i + 1]):
            out.append(chunk[starts[i] : ends[i + 1]])
            i += 2
        else:
            out.append(chunk[starts[i] : ends[i]])
            i += 1
    return out


def _clean(name: str) -> str:
    name = name.strip(_WS)
    while len(name) > 1 and _PAIRS.get(name[0]) == name[-1]:
        name = name[1:-1].replace('\\"', '"').replace("\\'", "'").strip(_WS)
    return name


class _Grammar:
    """The rules over one field."""

    def __init__(self, text: str) -> None:
        self.text, self.flag = text, 0
        self.closes = _closes(text) if "(" in text or "（" in text else {}

    def spaces(self, at: int) -> int:
        m = _SPACE.match(self.text, at)
        return m.end() if m else at

    def affil(self, at: int) -> int:
        return self.closes.get(at, -1)

    def quote(self, at: int) -> int:
        for rule in (_DOUBLE, _SINGLE):
            if m := rule.match(self.text, at):
                return m.end()
        return -1

    def bracket(self) -> list[str]:
        """The quotes of a bracket that is the whole field, or none."""
        out: list[str] = []
        at = self.spaces(1)
        while (end := self.quote(at)) >= 0:
            out.append(self.text[at:end])
            at = self.spaces(end)
            if self.text[at : at + 1] == ",":
                at = self.spaces(at + 1)
        return out if self.text[at : at + 1] == "]" and self.spaces(at + 1) == len(self.text) else []

    def item(self, at: int) -> int:
        m = _DOUBLE.match(self.text, at)
        if not m:
            return -1
        then = self.spaces(m.end())
        if (end := self.affil(then)) >= 0:
            then = self.spaces(end)
        ends = then == len(self.text) or self.text[then] in ",;|&/，；、·]\"'" or any(c in "\n\r\t" for c in self.text[m.end() : then]) or re.compile(r"\band\b").match(self.text, then)
        return m.end() if ends else -1

    def conjunction(self, at: int) -> int:
        """and, with the blanks around it."""
        then = self.spaces(at)
        if self.text[then : then + 1] == "&":
            return self.spaces(then + 1)
        if then > at and self.text.startswith("and", then) and (end := self.spaces(then + 3)) > then + 3:
            return end
        return -1

    def separator(self, at: int) -> int:
        c = self.text[at]
        if c in ";|\n\r\t；、":
            return at + 1
        if c.isspace() and self.text[at + 1 : at + 2] in ("/", "·") and self.text[at + 2 : at + 3].isspace():
            return at + 3
        return -1

    def joined(self, now: str, end: int) -> bool:
        """Whether what the conjunction parts is one name all the same."""
        word = now.strip(_WS)
        if word and " " not in word and self.text.startswith(word, end):
            then = self.spaces(end + len(word))
            if then == len(self.text) or self.text[then] in ",;|；、，(（\n":
                return True
        return bool(_SUBJECT.search(now.rstrip()))

    def values(self) -> list[tuple[str, bool]]:
        """The chunks of the list, and whether each is a quoted item."""
        text, n = self.text, len(self.text)
        if _LISTED.match(text) and not ("and" in text and _AND.search(text)):
            return [(c, False) for c in _STRONG.split(text) if c.strip(_WS)]
        out: list[tuple[str, bool]] = []
        now, after_item, at = "", False, 0
        while at < n:
            if (end := self.affil(at)) >= 0:
                at = end
                continue
            c = text[at]
            if c == '"':
                held = now.strip(_WS + ",")
                end = self.item(at)
                if end >= 0 and held and not now.rstrip().endswith((",", "，")):
                    now += text[at:end]  # within a bare value
                elif end >= 0:
                    out += [(now, False), (text[at:end], True)]
                    now, after_item = "", True
                else:
                    self.flag |= QUOTE
                    end = at + 1
            elif (end := self.separator(at)) >= 0:
                out.append((now, False))
                now, after_item = "", False
            elif (c == "&" or c.isspace()) and (end := self.conjunction(at)) >= 0:
                if self.joined(now, end):
                    now += text[at:end]
                else:
                    out.append((now, False))
                    now, after_item = "", False
            elif c in ",，":
                end = at + 1
                if not (after_item and not now.strip(_WS)):
                    now += c
                after_item = False
            elif m := _RUN.match(text, at):
                end = m.end()
                now += m.group()
            else:
                end = at + 1
                if c in "()（）":
                    self.flag |= PARENS
                now += c
            at = end
        out.append((now, False))
        return [(c, q) for c, q in out if c.strip(_WS)]


def _closes(text: str) -> dict[int, int]:
    """The place after the parenthesis that closes each one, for those that are closed."""
    out: dict[int, int] = {}
    for left, right in ("()", "（）"):
        stack: list[int] = []
        for m in re.finditer(f"[{left}{right}]", text):
            if m.group() == left:
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.end()
    return out


def _without_affiliations(text: str) -> str:
    """The text without its parenthesised parts and the blanks before them."""
    closes = _closes(text)
    kept, at = [], 0
    for begin in sorted(closes):
        if begin >= at:
            kept.append(text[at:begin].rstrip())
            at = closes[begin]
    return "".join([*kept, text[at:]])


def parse_packed(text: str | None) -> list[tuple[str, int]]:
    """The values of one field with their flags: 1 malformed quote, 2 malformed bracket, 4 empty place, 8 unbalanced parenthesis.

    None, blank texts and placeholders have no values.
    """
    if text is None:
        return []
    bare = text.strip(_WS)
    if bare.lower() in PLACEHOLDERS:
        return []
    flag = 0
    if _EASY.match(bare) and " and " not in bare:
        chunks: list[tuple[str, bool]] = [(c, False) for c in bare.split(";")]
    elif bare[0] == "[" and (quotes := _Grammar(bare).bracket()):
        chunks = [(q, True) for q in quotes]
    else:
        if bare[0] == "[":
            flag |= BRACKET
            bare = bare[1:-1] if bare.endswith("]") else bare[1:]
        g = _Grammar(bare)
        chunks = g.values()
        flag |= g.flag
    out = []
    for chunk, whole in chunks:
        for name in [chunk] if whole else _names(chunk):
            name = _clean(_without_affiliations(name) if "(" in name or "（" in name else name).strip(_WS + ",;")
            if name.lower() in PLACEHOLDERS or not any(c.isalnum() for c in name):
                flag |= EMPTY if name else 0
                continue
            out.append((name, flag))
    return out


def split_packed(df: DataFrame, column: str, keys: list[str], value: str = "value") -> DataFrame:
    """One row per value of a packed field: the keys, pos from 0, the value and its error flags.

    Null, blank and placeholder fields give no row; repeated input rows give repeated output rows;
    texts of any length are read whole. Other columns of df are not read, so their names may clash.
    """
    cols = [F.col(f"`{k}`") for k in keys]
    src = df.select(*cols, F.col(f"`{column}`").alias("__packed"))
    fields = [T.StructField(k, src.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("pos", T.IntegerType()), T.StructField(value, T.StringType()), T.StructField("flags", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, poss, vals, flags = [], [], [], []
            for i, text in enumerate(batch.column("__packed").to_pylist()):
                for pos, (name, flag) in enumerate(parse_packed(text)):
                    rows.append(i)
                    poss.append(pos)
                    vals.append(name)
                    flags.append(flag)
            at = pa.array(rows, pa.int32())
            kept = [batch.column(k).take(at) for k in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(poss, pa.int32()), pa.array(vals, pa.string()), pa.array(flags, pa.int32())], names=[*keys, "pos", value, "flags"])

    return src.mapInArrow(run, schema)
