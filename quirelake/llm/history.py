"""Deduplicating new batches against all history (problem 6).

Method: multi-key sorted-neighbourhood runs. Every record has several keys: its id, its DOI, its title
with its authors, and its title in several orders. The orders are cut into key ranges, whose bounds are kept with the history. A
batch is sorted into these ranges and merged there with what the runs hold of them; the rows of other ranges are
not read. In each range the releases of the batch come one after the other, oldest first: a title that is new is compared
with WINDOW titles on each side of it among those there at the time, and old titles are not compared with each other
again. Equal keys meet whatever their number. Pairs of near titles are kept too, so a later record of an old title finds what was
near it. The rows of a batch become a run of each range; when there are many runs they are compacted, and the ranges are cut anew.

As every release sees what was there before it, releases given at once and one by one have the same result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.functions.missing import PLACEHOLDERS, doi_key
from quirelake.llm.golden import instant
from quirelake.llm.names import _HEADS, _SMALL, _TITLES, GIVEN, LEGAL_FORMS
from quirelake.llm.titles import fold, missing, plain, plain_parts, title_parts
from quirelake.operators.packed import parse_packed
from quirelake.session import spool, spool_path

#: Titles compared on each side of a new one, in each order of the titles.
WINDOW = 8
#: Orders of the words by a hash, besides the title forward, backward and by author.
WORD_ORDERS = 3
MAX_RUNS = 8
#: Sorted rows of a key range, about: at most, and at least while there are fewer ranges than tasks; and the most ranges, whose bounds every task holds.
RANGE_ROWS, LEAST_ROWS, MAX_RANGES = 150_000, 5_000, 20_000
#: Rows per range of the sample that the bounds are taken from.
SAMPLED = 20
#: Folders of a run of keys and lists by a hash of venue and year; those a batch does not touch are not read.
PARTS = 64
#: How the runs, and what waits on disk for them, are written: titles are there once for each order, which this packs best for its time.
_PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Ranges whose borders are compared by one task, and ranges it shares with the next.
BORDERS, SHARED = 64, 3

# Words that two forms of one title may differ in.
_FUNCTION = frozenset("a an the on of for in with using by via through under from at to and over into towards".split())
# Words that make a title that of a later paper.
_SEQUEL = frozenset("ii iii iv vi vii part revisited replication independent later years two three four five again continued reply response comment correction erratum corrigendum retraction extension sequel follow followup".split())
# Titles of front matter, which name no paper.
_GENERIC = re.compile(r"(?:front|back)matter|(?:guest)?editorials?|messagefromthe\w{1,30}|tableofcontents|contents|(?:author|subject|keyword)?index|preface|foreword|(?:pc|program|programme|organizing|technical)committee\w*|acknowledge?ments?|titlepage|copyright\w*|welcome\w*|erratum|corrigendum|reviewers|cover|announcements?|inmemoriam")
_WORD = re.compile(r"[^\W_]+")
_JOINING = re.compile(r"[-‐‑'’]")
#: For ASCII texts: what parts words becomes a blank.
_BLANKS = bytes(c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
#: A quote with letters, or what joins them, on both sides.
_INNER_QUOTE = re.compile("[\\w‐‑'’-]\"+[\\w‐‑'’-]")
_BLANK = re.compile(r"\s+")
_ID_PREFIX = re.compile(r"^(?:published-|id:)+")
_ID_VERSION = re.compile(r"(?<=[0-9a-z])v\d+$")
_NOT_ID = re.compile(r"[^0-9a-z]+")


def id_key(paper_id: str | None) -> str:
    """A paper id without case, blanks, separators, the prefixes of sources and a version number."""
    if missing(paper_id):
        return ""
    low = _ID_PREFIX.sub("", _BLANK.sub("", plain(paper_id)))
    return _NOT_ID.sub("", _ID_VERSION.sub("", low))


def author_words(authors: str | None) -> set[str]:
    """Words of the authors' names in full form, folded, of organisations the first.

    Where the field is cut does not change its words, so the grammar reads only fields that may hold an organisation, a placeholder,
    an 'and', or marks that take words out or run them together.
    """
    if authors is None:
        return set()
    if "(" not in authors and "（" not in authors and "\\" not in authors and not ("''" in authors and "[" in authors) and not ('"' in authors and _INNER_QUOTE.search(authors)):
        written = authors.encode().translate(_BLANKS, b"-'").decode().split() if authors.isascii() else _WORD.findall(_JOINING.sub("", authors))
        words = set(map(_known_words.__getitem__, written))
        if None not in words:
            words.discard("")
            return words
    out: set[str] = set()
    for name, _ in parse_packed(authors):
        out.update(_name_words(name))
    return out


#: Words that only the grammar can judge.
_JUDGED = _HEADS | {w for w, full in LEGAL_FORMS.items() if full in _HEADS} | {"of", "for", "on", "and"} | {w for p in PLACEHOLDERS for w in _WORD.findall(_JOINING.sub("", p)) if len(w) > 1}


class _Words(dict[str, str | None]):
    """A word as written: its full form, folded; nothing if it does not count; None if the grammar has to judge. Kept while there are not too many."""

    def __missing__(self, word: str) -> str | None:
        if len(self) >= 1 << 15:
            self.clear()
        w = fold(word)
        out = self[word] = None if w in _JUDGED or word.lower() in _JUDGED else GIVEN.get(w, w) if len(w) > 1 and w not in _TITLES else ""
        return out


_known_words = _Words()


@lru_cache(1 << 13)
def _name_words(name: str) -> tuple[str, ...]:
    """Words of one name; most names come again in other lists."""
    before, comma, after = name.partition(",")
    if comma:
        name = after + " " + before
    words = [fold(w) for w in _WORD.findall(_JOINING.sub("", name))]
    spread = {LEGAL_FORMS.get(w, w) for w in words}
    if spread & _HEADS or {"of", "for", "on"} & spread:
        core = [w for w in words if w not in _SMALL]
        return tuple(core[:1])
    return tuple(GIVEN.get(w, w) for w in words if len(w) > 1 and w not in _TITLES)


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) >> 1


class _Hashes(dict[str, int]):
    """Hashes of words with one seed, kept while there are not too many."""

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 15:
            self.clear()
        out = self[word] = _hash(word, self.seed)
        return out


@lru_cache(1 << 16)
def _letters_of(word: str) -> int:
    """A bit for each letter."""
    out = 0
    for c in word:
        out |= 1 << ord(c) % 64
    return out


def same_authors(a: str, b: str) -> bool:
    """Whether more than half of the words of the shorter list of authors are in the other, written alike or with a typing error.

    a and b are words between blanks, each once. Lists without any word agree with none.
    """
    if a == b:
        return a != ""
    x, y = set(a.split(" ")), set(b.split(" "))
    if not a or not b:
        return False
    if len(x) > len(y):
        x, y = y, x
    common = x & y
    missing_yet = len(x) // 2 + 1 - len(common)
    if missing_yet <= 0:
        return True
    left = sorted(y - common)
    for w in sorted(x - common):
        n = len(w)
        most = 2 if n > 5 else 1 if n > 2 else 0
        bits = _letters_of(w)
        for v in left:
            # an edit adds one letter and takes one away at most
            if most and abs(len(v) - n) <= most and (bits ^ _letters_of(v)).bit_count() <= 2 * most and _distance(w, v, most) <= most:
                left.remove(v)
                missing_yet -= 1
                if not missing_yet:
                    return True
                break
    return False


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance with exchanged neighbours, most + 1 if larger than most; only the band around the diagonal is filled."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    at = 0
    while at < n and at < m and a[at] == b[at]:
        at += 1
    if at:
        a, b, n, m = a[at:], b[at:], n - at, m - at
    far = most + 1
    before: list[int] = [far] * (m + 2)
    row = [j if j <= most else far for j in range(m + 1)] + [far]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        now = [far] * (m + 2)
        if i <= most:
            now[0] = i
        x, least = a[i - 1], now[0]
        for j in range(lo, hi + 1):
            d = row[j - 1] + (x != b[j - 1])
            if row[j] + 1 < d:
                d = row[j] + 1
            if now[j - 1] + 1 < d:
                d = now[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1] and before[j - 2] + 1 < d:
                d = before[j - 2] + 1
            now[j] = d
            if d < least:
                least = d
        if least > most:
            return far
        before, row = row, now
    return min(row[m], far)


def _content(title: str) -> list[str]:
    words = title.encode().translate(_BLANKS).decode().split() if title.isascii() else _WORD.findall(title)
    if "extended" in words:
        for i in range(len(words) - 1):
            if words[i] == "extended" and words[i + 1] == "abstract":
                words = words[:i] + words[i + 2 :]
                break
    return [w for w in words if w not in _FUNCTION]


def _is_mark(word: str) -> bool:
    return word in _SEQUEL or not word.isalpha() and any(c.isdigit() for c in word)


def _marks(words: list[str]) -> list[str]:
    return sorted(w for w in words if _is_mark(w))


def nearly_same(a: str, b: str) -> bool:
    """Whether two plain titles are nearly the same.

    They may differ by up to three typing errors, exchanged or function words, one word left out, a note that
    it is an extended abstract, and an end cut off; not by a number or a word of a sequel.
    """
    return _near_contents(_content(a), _content(b), _is_cut(a), _is_cut(b))


def _is_cut(title: str) -> bool:
    return title.rstrip().endswith("...")


def _in_reach(a: str, b: str, most: int) -> bool:
    """False only if the edit distance of a and b is more than most.

    An edit touches two neighbouring letters of a at most, so of 2 * most + 1 pieces of a one is left as it is, and it is moved by
    as many places as there are edits at most.
    """
    n, pieces = len(a), 2 * most + 1
    for i in range(pieces):
        begin, end = n * i // pieces, n * (i + 1) // pieces
        if b.find(a[begin:end], begin - most if begin > most else 0, end + most) >= 0:
            return True
    return False


def _near_contents(wa: list[str], wb: list[str], cut_a: bool, cut_b: bool) -> bool:
    """nearly_same by the content words of the titles, and whether they have a mark that they are cut off."""
    la, lb = "".join(wa), "".join(wb)
    if la == lb and la:
        return True
    if min(len(la), len(lb)) < 8:
        return False
    # as many words are taken from both, so their numbers differ by as many before
    rest_a: list[str] = []
    rest_b = list(wb)
    if abs(len(wa) - len(wb)) <= 1:
        for w in wa:
            if w in rest_b:
                rest_b.remove(w)
            else:
                rest_a.append(w)
    if abs(len(wa) - len(wb)) <= 1 and min(len(rest_a), len(rest_b)) <= 3 and _marks(rest_a) == _marks(rest_b):
        left_a, left_b, errors = list(rest_a), list(rest_b), 0
        for w in rest_a:
            most = 2 if len(w) > 5 else 1
            bits = _letters_of(w)
            near = min(((_distance(w, v, most), v) for v in left_b if (bits ^ _letters_of(v)).bit_count() <= 2 * most), default=(3, "")) if len(w) > 2 else (3, "")
            if near[0] <= most:
                errors += near[0]
                left_a.remove(w)
                left_b.remove(near[1])
        if len(left_a) + len(left_b) <= 1 and errors <= 4 and len(wa) > 2:
            return True
        # words run together or apart
        if len(la) > 20 and abs(len(la) - len(lb)) <= 3 and _distance(la, lb, 3) <= 3:
            return True
    # the end cut off
    short, long, ws, wl, cut_off = (la, lb, wa, wb, cut_a) if len(la) <= len(lb) else (lb, la, wb, wa, cut_b)
    left = len(long) - len(short)
    if len(short) < 20 or left < (1 if cut_off else 4) or not _in_reach(short, long, 4) or _distance(short, long[: len(short)], 4) > 4:
        return False
    if cut_off:
        return True
    # without a mark of the cut, it lies within a word, or one word is gone that is none of a sequel's
    size, rest = 0, []
    for w in wl:
        if size >= len(short) - 2:
            rest.append(w)
        size += len(w)
    if rest and all(_is_mark(w) for w in rest):
        return False
    return ws[-1] not in wl or len(wl) - len(ws) == 1


_PREPARED = "record_id string, o bigint, doi string, block bigint, pid string, tkey bigint, title string, generic boolean, names string"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in ("paper_id", "title", "normalized_title", "authors")}
        tkeys, titles, generic, names = [], [], [], []
        for t, n, a in zip(col["title"], col["normalized_title"], col["authors"], strict=True):
            shown = "" if missing(t) else plain(t)
            parts = plain_parts(shown) or title_parts(None, n)
            tkeys.append(_hash("".join(sorted(parts))) if parts else None)
            titles.append(shown if not missing(t) else plain(n) if parts else "")
            generic.append(bool(parts) and bool(_GENERIC.fullmatch("".join(parts))))
            names.append(" ".join(sorted(author_words(a))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("record_id"), batch.column("o"), batch.column("doi"), batch.column("block"), pa.array(map(id_key, col["paper_id"]), pa.string()), pa.array(tkeys, pa.int64()), pa.array(titles, pa.string()), pa.array(generic, pa.bool_()), pa.array(names, pa.string())],
            names=["record_id", "o", "doi", "block", "pid", "tkey", "title", "generic", "names"],
        )


def prepare(records: DataFrame, releases: DataFrame) -> DataFrame:
    """The keys of each record of a known release. o is the instant of its release."""
    order = releases.where("release_id IS NOT NULL").select("release_id", instant(F.col("created_at")).cast("bigint").alias("o")).groupBy("release_id").agg(F.min("o").alias("o")).where("o > 0")
    return (
        records.where("record_id IS NOT NULL")
        .select("record_id", "release_id", "doi", "venue", "year", "paper_id", "title", "normalized_title", "authors")
        .join(order, "release_id")
        .select("record_id", "o", doi_key(F.col("doi")).alias("doi"), F.xxhash64("venue", "year").alias("block"), "paper_id", "title", "normalized_title", "authors")
        .mapInArrow(_prepare, _PREPARED)
    )


def _key(kind: str, *parts: str):
    cols = [F.lit(kind), F.col("block"), *[F.col(p) if isinstance(p, str) else p for p in parts]]
    return F.struct(F.lit(kind).alias("kind"), F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit("again"), *reversed(cols)).alias("h2"))


def _keys(prepared: DataFrame, reading: bool) -> DataFrame:
    """One row per record and key. A record without authors may be any of its title; others read those without authors."""
    alone = F.col("names") == ""
    titled = F.col("tkey").isNotNull() & ~F.col("generic")
    keys = [
        F.when(F.col("pid") != "", _key("id", "pid")),
        F.when(F.col("doi").isNotNull(), _key("doi", "doi")),
        F.when(titled & (alone if reading else F.lit(True)), _key("any", "tkey")),
        F.when(titled & (~alone if reading else alone), _key("alone", "tkey")),
    ]
    rows = prepared.select("record_id", "o", _part(), F.col("doi").isNotNull().alias("has_doi"), F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k"))
    return rows.select("record_id", "o", "part", "has_doi", "k.kind", "k.h1", "k.h2")


def _part():
    return F.pmod("block", F.lit(PARTS)).cast("int").alias("part")


def _summed(keys: DataFrame) -> DataFrame:
    return keys.groupBy("h1", "h2", "kind").agg(F.min("part").alias("part"), F.min("o").alias("o_any"), F.min(F.when(~F.col("has_doi"), F.col("o"))).alias("o_nodoi"), F.max("o").alias("o_max"))


def _list_id():
    return F.xxhash64("names", "generic").alias("list_id")


def _lists(prepared: DataFrame) -> DataFrame:
    """One row per block, title and list of authors: when it came. Front matter without authors has none."""
    some = prepared.where("tkey IS NOT NULL AND (NOT generic OR names <> '')")
    return some.groupBy("tkey", "block", _list_id()).agg(F.min(_part()).alias("part"), F.min("o").alias("o_any"), F.min(F.when(F.col("doi").isNull(), F.col("o"))).alias("o_nodoi"), F.max("o").alias("o_max"), F.min("title").alias("title"), F.min("names").alias("names"), F.min("generic").alias("generic"))


_AGREED = "block bigint, tkey bigint, list_id bigint, near_any bigint, near_nodoi bigint"


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose lists of authors agree; with near titles (near), a list without authors agrees with any."""
    for batch in batches:
        near = batch.column("near").to_pylist()
        at = [i for i, (a, b) in enumerate(zip(batch.column("names").to_pylist(), batch.column("other").to_pylist(), strict=True)) if near[i] and not (a and b) or same_authors(a, b)]
        yield batch.take(pa.array(at, pa.int32())).select(["block", "tkey", "list_id", "near_any", "near_nodoi"])


def same_titles(mine: DataFrame, every: DataFrame) -> DataFrame:
    """block, tkey, list_id and the arrivals of the same title with the same authors; each list of authors meets all others of its title."""
    named = every.where("names <> ''").select("block", "tkey", "list_id", "o_any", "o_nodoi", "o_max", "names")
    again = named.groupBy("tkey", "block").agg(F.min("o_any").alias("lo"), F.max("o_max").alias("hi")).where("lo < hi").select("block", "tkey")
    several = spool(named.join(again, ["tkey", "block"], "left_semi"), "same-titles", **_PACKED)
    other = several.select("block", "tkey", F.col("o_any").alias("near_any"), F.col("o_nodoi").alias("near_nodoi"), F.col("names").alias("other"))
    wanted = several if mine is every else several.join(mine.select("block", "tkey", "list_id"), ["tkey", "block", "list_id"], "left_semi")
    return wanted.join(other, ["tkey", "block"]).where("near_any < o_max").select("block", "tkey", "list_id", "near_any", "near_nodoi", "names", "other", F.lit(False).alias("near")).mapInArrow(_agreeing, _AGREED)


_ROW = ("way", "block", "skey", "tkey", "title", "first")
_ROW_SCHEMA = "way int, block bigint, skey string, tkey bigint, title string, first bigint"


def _by_title(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each title with each of its sort keys."""
    orders = [_Hashes(100 + s) for s in range(WORD_ORDERS)]
    for batch in batches:
        ways, keys = [], []
        for title in batch.column("title").to_pylist():
            words = _content(title)
            text = "".join(words)
            keys += [text, text[::-1], *[" ".join(sorted(words, key=h.__getitem__)) for h in orders]]
            ways += range(WORD_ORDERS + 2)
        yield _rows(batch, ways, keys)


def _by_author(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each title with the sort keys that begin with an author of the list, chosen by a hash."""
    chosen = [_Hashes(s) for s in range(2)]
    for batch in batches:
        ways, keys = [], []
        for title, names in zip(batch.column("title").to_pylist(), batch.column("names").to_pylist(), strict=True):
            text = "".join(_content(title))
            people = names.split(" ")
            for s, t in enumerate((text, text[::-1])):
                keys.append(f"{min(map(chosen[s].__getitem__, people)):x} {t}")
                ways.append(WORD_ORDERS + 2 + s)
        yield _rows(batch, ways, keys)


def _rows(batch: pa.RecordBatch, ways: list[int], keys: list[str]) -> pa.RecordBatch:
    take = pa.array(np.repeat(np.arange(batch.num_rows), len(ways) // max(1, batch.num_rows)))
    col = {"way": pa.array(ways, pa.int32()), "skey": pa.array(keys, pa.string())}
    return pa.RecordBatch.from_arrays([col[c] if c in col else batch.column(c).take(take) for c in _ROW], names=list(_ROW))


def sorted_rows(lists: DataFrame, place: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """The rows of all orders: a title by itself once, and with an author's hash once for each; with place also the range it gives them.

    The range is given in the same step, so that the rows go through Python once.
    """
    schema = f"{_ROW_SCHEMA}, range int" if place else _ROW_SCHEMA
    some = lists.where("NOT generic")
    titles = some.groupBy("tkey", "block").agg(F.min("title").alias("title"), F.min("o_any").alias("first"))
    named = some.where("names <> ''").select("block", "tkey", "title", "names", F.col("o_any").alias("first"))
    by_title, by_author = (partial(_placed, rows, place) if place else rows for rows in (_by_title, _by_author))
    return titles.mapInArrow(by_title, schema).unionAll(named.mapInArrow(by_author, schema))


def _placed(rows: Callable, place: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from place(rows(batches))


_NEAR = 4
_BINS = 32


def _letter_counts(ways: np.ndarray, keys: pa.Array | list[str]) -> np.ndarray:
    """How often each letter is in each key, letters being numbered modulo 32; blanks and what shares their number do not count."""
    keys = pa.array(keys, pa.string()) if isinstance(keys, list) else keys
    out = np.zeros((len(keys), _BINS), np.int8)
    for begin in range(0, len(keys), 4_000):  # few enough for the processor's cache
        some = keys.slice(begin, 4_000)
        at = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1]
        if at[0] == at[-1]:
            continue
        flat, lengths = np.frombuffer(some.buffers()[2], np.uint8)[at[0] : at[-1]], np.diff(at)
        letters = flat & (_BINS - 1)
        if flat.max() >= 0x80:
            # of the bytes of a letter beyond ASCII the last has its number modulo 32, the others do not count
            goes_on = (flat & 0xC0) == 0x80
            letters[(flat >= 0x80) & ~(goes_on & ~np.r_[goes_on[1:], False])] = 0
        by_author = ways[begin : begin + 4_000] >= WORD_ORDERS + 2
        if by_author.any():  # the hash before the blank is none of the title
            hashed = np.where(by_author, pc.find_substring(some, " ").to_numpy(zero_copy_only=False) + 1, 0)
            letters[np.arange(len(flat)) < np.repeat(at[:-1] - at[0] + hashed, lengths)] = 0
        n = np.bincount(np.repeat(np.arange(0, len(some) * _BINS, _BINS), lengths) + letters, minlength=len(some) * _BINS)
        out[begin : begin + 4_000] = np.minimum(n, 120).reshape(-1, _BINS)
    out[:, 0] = 0
    return out


def _at_least(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each letter that is there once, twice; and three, four times. The bits that one has and another has not are no more than its letters that the other has not."""
    once, twice, thrice, four = (np.packbits(counts >= k, axis=1).view(np.uint32).ravel().astype(np.uint64) for k in range(1, 5))
    return once << np.uint64(32) | twice, thrice << np.uint64(32) | four


def _near_rows(way: np.ndarray, block: np.ndarray, tkey: np.ndarray, first: np.ndarray, fresh: np.ndarray, keys: pa.Array | list[str], titles: pa.Array, source: np.ndarray | None = None) -> set[tuple[int, int, int]]:
    """(block, title, near title) among sorted rows: each fresh row against WINDOW rows on each side of those that had come by then.

    Of two nearly same titles one has at most _NEAR letters that the other has not (four errors, or the end cut
    off, or one word more), so pairs with more on both sides need no closer look: first by bits of their letters,
    which are few to compare, then by the letters' numbers. With source, only pairs of different sources are looked at.
    """
    out: set[tuple[int, int, int]] = set()
    if len(way) < 2 or not fresh.any():
        return out
    counts = _letter_counts(way, keys)
    few, many = _at_least(counts)
    group = block ^ (way.astype(np.int64) << 58)  # equal for rows of one way and block
    texts: dict[int, tuple[list[str], bool]] = {}

    def text(k: int) -> tuple[list[str], bool]:
        if k not in texts:
            if len(texts) >= 1 << 10:  # pairs come in the order of their rows, which are near each other
                texts.clear()
            title = titles[k].as_py()
            texts[k] = _content(title), _is_cut(title)
        return texts[k]

    for t in np.unique(first[fresh]).tolist():
        active = np.flatnonzero(first <= t)
        new = fresh[active] & (first[active] == t)
        at = np.flatnonzero(new)
        g, x, y = group[active], few[active], many[active]
        pairs = [(at[:0], at[:0])]
        for lag in [*range(1, WINDOW + 1), *range(-WINDOW, 0)]:
            mine = at[np.searchsorted(at, lag) :] if lag > 0 else at[: np.searchsorted(at, len(active) + lag)]
            other = mine - lag
            if lag < 0:  # of two new ones the later looks back
                old = ~new[other]
                mine, other = mine[old], other[old]
            more = less = np.uint8(0)
            for bits in (x, y):
                xa, xb = bits[mine], bits[other]
                more, less = more + np.bitwise_count(xa & ~xb), less + np.bitwise_count(xb & ~xa)
                ok = np.flatnonzero(np.minimum(more, less) <= _NEAR)
                mine, other, more, less = mine[ok], other[ok], more[ok], less[ok]
            ok = g[mine] == g[other]
            a, b = active[mine[ok]], active[other[ok]]
            ok = (way[a] == way[b]) & (block[a] == block[b]) & (tkey[a] != tkey[b])
            if source is not None:
                ok &= source[a] != source[b]
            a, b = a[ok], b[ok]
            for some in range(0, len(a), 20_000):
                i, j = a[some : some + 20_000], b[some : some + 20_000]
                more = counts[i] - counts[j]
                near = np.minimum(np.maximum(more, 0).sum(1, dtype=np.int32), np.maximum(-more, 0).sum(1, dtype=np.int32)) <= _NEAR
                pairs.append((i[near], j[near]))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for i, j, within, mine, other in zip(*(c.tolist() for c in (a, b, block[a], tkey[a], tkey[b])), strict=True):
            if (within, mine, other) in out:
                continue
            (wa, cut_a), (wb, cut_b) = text(i), text(j)
            if _near_contents(wa, wb, cut_a, cut_b):
                out.add((within, mine, other))
    return out


def _border_rows(first: np.ndarray) -> np.ndarray:
    """The rows that may be within WINDOW rows of the range's ends, at the time of any release."""
    keep: set[int] = set()
    for t in np.unique(first).tolist():
        there = np.flatnonzero(first <= t)
        keep.update(there[:WINDOW].tolist(), there[-WINDOW:].tolist())
    return np.array(sorted(keep), np.int64)


#: What a range gives: pairs of near titles (0), the rows near its ends (1), and the rows of the batch, which become a run (2).
PAIR, END, RUN = 0, 1, 2
_FOUND = f"kind int, range int, place int, fresh boolean, other bigint, {_ROW_SCHEMA}"


def _gives(kind: int, at: int, rows: pa.Table | None, n: int, fresh: np.ndarray | None = None, **columns: list[int]) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "range": pa.int32(), "place": pa.int32(), "fresh": pa.bool_(), "other": pa.int64(), "way": pa.int32(), "block": pa.int64(), "skey": pa.string(), "tkey": pa.int64(), "title": pa.string(), "first": pa.int64()}
    out = []
    for c, kind_of in kinds.items():
        if c == "kind":
            out.append(pa.array(np.full(n, kind, np.int32)))
        elif c == "range":
            out.append(pa.array(np.full(n, at, np.int32)))
        elif c == "place":
            out.append(pa.array(np.arange(n, dtype=np.int32)))
        elif c == "fresh" and fresh is not None:
            out.append(pa.array(fresh, pa.bool_()))
        elif c in columns:
            out.append(pa.array(columns[c], kind_of))
        elif rows is not None and c in rows.column_names:
            out.append(rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c))
        else:
            out.append(pa.nulls(n, kind_of))
    return pa.RecordBatch.from_arrays([x if not isinstance(x, pa.ChunkedArray) else x.combine_chunks() for x in out], names=list(kinds))


def _window(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """What each sorted range of the partition gives. A range, with the rows of all runs, is held at once; its size is bounded."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        ranges = batch.column("range").to_numpy(zero_copy_only=False)
        begin = 0
        for end in [*(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]:
            if end == begin:
                continue
            if at is not None and ranges[begin] != at:
                yield from _one_range(held, int(at), keep)
                held = []
            at = ranges[begin]
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield from _one_range(held, int(at), keep)


def _one_range(held: list[pa.RecordBatch], at: int, keep: bool) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    way, block, tkey, first = (rows.column(c).to_numpy() for c in ("way", "block", "tkey", "first"))
    new = rows.column("new").to_numpy(zero_copy_only=False)
    skey = rows.column("skey").combine_chunks()
    if keep:
        mine = rows if new.all() else rows.filter(pa.array(new))
        for begin in range(0, mine.num_rows, 50_000):
            part = mine.slice(begin, 50_000)
            yield _gives(RUN, at, part, part.num_rows)
    # rows of one title and key, from several runs, are one; it is new if it was in none
    begins = np.flatnonzero(np.r_[True, (way[1:] != way[:-1]) | (block[1:] != block[:-1]) | (tkey[1:] != tkey[:-1]) | pc.not_equal(skey[1:], skey[:-1]).to_numpy(zero_copy_only=False)])
    first, fresh = np.minimum.reduceat(first, begins), np.logical_and.reduceat(new, begins)
    if len(begins) < rows.num_rows:
        rows = rows.take(pa.array(begins)).combine_chunks()
        way, block, tkey = way[begins], block[begins], tkey[begins]
    titles = rows.column("title").combine_chunks()
    found = sorted(_near_rows(way, block, tkey, first, fresh, rows.column("skey").combine_chunks(), titles))
    yield _gives(PAIR, at, None, len(found), block=[f[0] for f in found], tkey=[f[1] for f in found], other=[f[2] for f in found])
    ends = _border_rows(first)
    edge = rows.take(pa.array(ends)).drop_columns(["first", "range", "new"])
    yield _gives(END, at, edge, len(ends), fresh[ends], first=first[ends].tolist())


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across the ends of neighbouring ranges, of which each group holds some in order."""
    table = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    for g in sorted(set(table.column("grp").to_pylist())):
        rows = table.filter(pa.array((table.column("grp").to_numpy() == g).tolist())).combine_chunks()
        way, block, tkey, first, source = (rows.column(c).to_numpy() for c in ("way", "block", "tkey", "first", "range"))
        found = sorted(_near_rows(way, block, tkey, first, rows.column("fresh").to_numpy(zero_copy_only=False), rows.column("skey").combine_chunks(), rows.column("title").combine_chunks(), source))
        yield _gives(PAIR, 0, None, len(found), block=[f[0] for f in found], tkey=[f[1] for f in found], other=[f[2] for f in found])


class History:
    """Runs of all accepted batches in a folder that all executors share, and the bounds of their key ranges."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or spool_path(spark, "history")
        self.runs: list[str] = []
        self.bounds: list[tuple[int, int, str]] | None = None
        self.made = self.rows = 0

    def _at(self, what: str, run: str) -> str:
        return f"{self.path}/{what}/run={run}"

    def _read(self, what: str, where: str) -> DataFrame:
        """What the runs hold in the folders that the condition names."""
        return self.spark.read.option("basePath", f"{self.path}/{what}").schema(_HELD[what]).parquet(*[self._at(what, r) for r in self.runs]).where(where).drop("run")

    def cut(self, lists: DataFrame) -> None:
        """Chooses the bounds of the key ranges from a sample of the sorted rows; it comes to the driver, SAMPLED rows per range."""
        n = lists.count() * (WORD_ORDERS + 4)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = min(MAX_RANGES, max(-(-n // RANGE_ROWS), min(tasks, n // LEAST_ROWS)))
        self.bounds = []
        if ranges > 1:
            part = lists.where(F.pmod(F.xxhash64("tkey", "block", F.lit("sample")), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLED * ranges / n)))
            rows = sorted((r["way"], r["block"], r["skey"]) for r in sorted_rows(part).select("way", "block", "skey").toLocalIterator())
            self.bounds = sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)}) if rows else []

    def ranged(self, rows: DataFrame) -> DataFrame:
        """The rows with the number of their range."""
        return rows.mapInArrow(self._place(), f"{_ROW_SCHEMA}, range int")

    def _place(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Gives rows the number of their range."""
        bounds = self.bounds or []
        heads = [k[:2] for k in bounds]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                # rows whose way and block no bound has are all in one range
                blocks, block = np.unique(b.column("block").to_numpy(), return_inverse=True)
                pairs, pair = np.unique(b.column("way").to_numpy().astype(np.int64) * len(blocks) + block, return_inverse=True)
                known = [(p // len(blocks), int(blocks[p % len(blocks)])) for p in pairs.tolist()]
                lo, hi = (np.array([f(heads, p) for p in known], np.int32) for f in (bisect.bisect_left, bisect.bisect_right))
                at, within = lo[pair], np.flatnonzero((lo < hi)[pair])
                for i, p, k in zip(within.tolist(), pair[within].tolist(), b.column("skey").take(pa.array(within)).to_pylist(), strict=True):
                    at[i] = bisect.bisect_right(bounds, (*known[p], k), lo[p], hi[p])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*_ROW, "range"])

        return run

    def accept(self, records: DataFrame, releases: DataFrame, keep: bool = True) -> DataFrame:
        """record_id of the records of which a release before theirs, in history or in this batch, holds the paper.

        A paper is the same within its venue and year by id, DOI or title with authors, written alike or
        nearly so; authors are the same if more than half of the words of the shorter list are in the other (same_authors); a record with a DOI is never that of another DOI. Records without authors are taken to
        be any paper of their title, except front matter. Records of no known release give no row and
        are not kept; repeated rows count once; a batch may hold several releases. Null and blank fields make no key.
        With keep the batch becomes a run of the history.
        """
        batch = spool(prepare(records, releases), "batch", **_PACKED)
        keys, lists = _summed(_keys(batch, False)), spool(_lists(batch), "lists", **_PACKED)
        n = lists.count() * (WORD_ORDERS + 4)
        if self.bounds is None or self.rows + n > 2 * RANGE_ROWS * (len(self.bounds) + 1):
            self.compact(lists)
        run = f"{self.made:05d}"
        if keep:
            self.made, self.rows = self.made + 1, self.rows + n
            keys.repartitionByRange("part", "h1").write.options(**_PACKED).partitionBy("part").parquet(self._at("keys", run))
            lists.repartitionByRange("part", "tkey").write.options(**_PACKED).partitionBy("part").parquet(self._at("lists", run))
            keys = self.spark.read.schema(_HELD["keys"]).parquet(self._at("keys", run))
        every, old_pairs = lists, None
        if self.runs:
            parts = [r[0] for r in lists.select("part").union(keys.select("part")).distinct().collect()]
            touched = f"part IN ({', '.join(map(str, parts))})" if parts else "false"
            mine = _keys(batch, True).select("kind", "h1", "h2").distinct()
            keys = _merged_keys(keys.unionByName(self._read("keys", touched).join(mine, ["h1", "h2", "kind"], "left_semi")))
            every = _merged_lists(lists.unionByName(self._read("lists", touched)))
            old_pairs = self._read("pairs", touched).select("block", "tkey", "other")
        pairs = self._near(lists, run, keep)
        if keep:
            self.runs.append(run)
            if len(self.runs) > MAX_RUNS:
                self.compact()
        return self._found(batch, keys, lists, every, pairs if old_pairs is None else pairs.unionAll(old_pairs))

    def _near(self, lists: DataFrame, run: str, keep: bool) -> DataFrame:
        """block, tkey and other of the pairs of near titles that the batch brings; with keep its rows are kept in their ranges."""
        rows = sorted_rows(lists, self._place()).withColumn("new", F.lit(True))
        if self.runs:
            rows = spool(rows, "batch-rows", **_PACKED)
            # with the neighbours of a range that is touched, as windows go on beyond its ends
            touched = sorted({r[0] + i for r in rows.select("range").distinct().collect() for i in (-1, 0, 1)})
            old = self._read("rows", f"kind = {RUN} AND range IN ({', '.join(map(str, touched))})" if touched else "false")
            rows = rows.unionAll(old.select(*_ROW, "range", F.lit(False).alias("new")))
        ordered = rows.repartitionById(len(self.bounds) + 1, F.col("range")).sortWithinPartitions("range", "way", "block", "skey", "tkey")
        out = self._at("rows", run) if keep else spool_path(self.spark, "near-titles")
        ordered.mapInArrow(lambda b: _window(b, keep), _FOUND).write.options(**_PACKED).partitionBy("kind", "range").parquet(out)
        found = self.spark.read.schema(_FOUND).parquet(out)
        first = F.floor(F.greatest(F.col("range") - SHARED, F.lit(0)) / BORDERS).cast("int")
        groups = F.explode(F.array_distinct(F.array(first, F.floor(F.col("range") / BORDERS).cast("int"))))
        ends = found.where(f"kind = {END}").withColumn("grp", groups)
        across = ends.repartitionById(len(self.bounds) // BORDERS + 1, F.col("grp")).sortWithinPartitions("grp", "range", "place").mapInArrow(_borders, _FOUND)
        pairs = found.where(f"kind = {PAIR}").unionByName(across).select("block", "tkey", "other").distinct()
        if not keep:
            return pairs
        pairs.select("*", _part()).write.options(**_PACKED).partitionBy("part").parquet(self._at("pairs", run))
        return self.spark.read.schema(_HELD["pairs"]).parquet(self._at("pairs", run)).select("block", "tkey", "other")

    def _found(self, batch: DataFrame, keys: DataFrame, lists: DataFrame, every: DataFrame, pairs: DataFrame) -> DataFrame:
        # a key that no later record has written can match only those that read without writing
        useful = keys.where("o_any < o_max OR kind = 'alone'")
        prior = F.when(F.col("has_doi") & (F.col("kind") != "doi"), F.col("o_nodoi")).otherwise(F.col("o_any"))
        equal = _keys(batch, True).drop("part").join(useful.drop("o_max", "part"), ["h1", "h2", "kind"]).where(prior < F.col("o")).select("record_id")
        both = pairs.unionAll(pairs.select("block", F.col("other").alias("tkey"), F.col("tkey").alias("other"))).distinct()
        mine = lists.where("NOT generic").select("block", "tkey", "list_id", "o_max", "names")
        theirs = every.where("NOT generic").select("block", F.col("tkey").alias("other"), F.col("o_any").alias("near_any"), F.col("o_nodoi").alias("near_nodoi"), F.col("names").alias("theirs"))
        met = both.join(mine, ["tkey", "block"]).join(theirs, ["other", "block"]).where("near_any < o_max")
        near = met.select("block", "tkey", "list_id", "near_any", "near_nodoi", "names", F.col("theirs").alias("other"), F.lit(True).alias("near")).mapInArrow(_agreeing, _AGREED)
        first = same_titles(lists, every).unionAll(near).groupBy("tkey", "block", "list_id").agg(F.min("near_any").alias("near_any"), F.min("near_nodoi").alias("near_nodoi"))
        held = batch.where("tkey IS NOT NULL").select("record_id", "o", "doi", "block", "tkey", _list_id()).join(first, ["tkey", "block", "list_id"])
        held = held.where(F.when(F.col("doi").isNull(), F.col("near_any")).otherwise(F.col("near_nodoi")) < F.col("o")).select("record_id")
        return equal.unionAll(held).distinct()

    def compact(self, more: DataFrame | None = None) -> None:
        """All runs become one, and the key ranges are cut anew, with room for more, so that they stay within their size."""
        run, held = f"{self.made:05d}", list(self.runs)
        lists = _merged_lists(self._read("lists", "true")) if held else more
        if held:
            self.made += 1
            _merged_keys(self._read("keys", "true")).repartitionByRange("part", "h1").write.options(**_PACKED).partitionBy("part").parquet(self._at("keys", run))
            lists.repartitionByRange("part", "tkey").write.options(**_PACKED).partitionBy("part").parquet(self._at("lists", run))
            self._read("pairs", "true").distinct().repartition("part").write.options(**_PACKED).partitionBy("part").parquet(self._at("pairs", run))
            lists = self.spark.read.schema(_HELD["lists"]).parquet(self._at("lists", run))
            if more is not None:
                lists = lists.unionByName(more)
        self.cut(lists)
        if held:
            rows = self.ranged(self._read("rows", f"kind = {RUN}").select(*_ROW)).repartitionById(len(self.bounds) + 1, F.col("range")).sortWithinPartitions("range", "way", "block", "skey", "tkey")
            rows.withColumn("kind", F.lit(RUN)).write.options(**_PACKED).partitionBy("kind", "range").parquet(self._at("rows", run))
            self.runs = [run]


_HELD = {
    "keys": "kind string, h1 bigint, h2 bigint, o_any bigint, o_nodoi bigint, o_max bigint, part int",
    "lists": "block bigint, tkey bigint, list_id bigint, o_any bigint, o_nodoi bigint, o_max bigint, title string, names string, generic boolean, part int",
    "pairs": "block bigint, tkey bigint, other bigint, part int",
    "rows": _FOUND,
}


def _merged_keys(keys: DataFrame) -> DataFrame:
    return keys.groupBy("h1", "h2", "kind").agg(F.min("part").alias("part"), F.min("o_any").alias("o_any"), F.min("o_nodoi").alias("o_nodoi"), F.max("o_max").alias("o_max"))


def _merged_lists(lists: DataFrame) -> DataFrame:
    return lists.groupBy("tkey", "block", "list_id").agg(F.min("part").alias("part"), F.min("o_any").alias("o_any"), F.min("o_nodoi").alias("o_nodoi"), F.max("o_max").alias("o_max"), F.min("title").alias("title"), F.min("names").alias("names"), F.min("generic").alias("generic"))
