"""Keyword-stuffed and link-list pages (problem 10).

Method: each page is cut into lines (long lines into pieces at sentence ends), each line gives one symbol of
a small alphabet, and a hidden Markov model labels the lines as prose, link list, tag list, menu or
other matter (tables, code, references). The model is trained on the symbol sequences of all pages by
expectation maximization, beginning from the fixed emissions below; equal sequences are counted
once. Pages are flagged by the share of their words in lines of links, tags and menus.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quirelake.session import spool

STATES = ("prose", "links", "tags", "menu", "other")
# The symbols of a line.
SYMBOLS = {
    "S": "sentences",
    "s": "words that run on as in a sentence",
    "L": "mostly addresses or links",
    "T": "short phrases between separators, or tags",
    "R": "words or phrases that repeat",
    "P": "product line with numbers and prices",
    "M": "short phrase alone on its line",
    "H": "heading",
    "C": "code, table or markup",
    "K": "a list of index terms, named as such",
    "Q": "reference",
    "N": "noise without words",
}
_START = {
    "prose": {"S": 0.6, "s": 0.25, "H": 0.05, "K": 0.02, "Q": 0.03, "C": 0.01, "M": 0.01, "N": 0.01, "T": 0.002, "R": 0.0005, "L": 0.001, "P": 0.0005},
    "links": {"L": 0.85, "H": 0.08, "M": 0.02, "T": 0.02, "R": 0.01, "N": 0.01, "S": 0.001, "s": 0.003, "C": 0.002, "K": 0.002, "Q": 0.001, "P": 0.001},
    "tags": {"T": 0.45, "R": 0.45, "M": 0.03, "H": 0.02, "K": 0.01, "N": 0.01, "P": 0.02, "s": 0.004, "S": 0.0005, "L": 0.004, "C": 0.0005, "Q": 0.0005},
    "menu": {"M": 0.5, "P": 0.4, "T": 0.03, "R": 0.03, "H": 0.02, "N": 0.01, "L": 0.004, "s": 0.004, "S": 0.0005, "C": 0.001, "K": 0.0005, "Q": 0.0005},
    "other": {"C": 0.5, "K": 0.2, "Q": 0.2, "H": 0.05, "M": 0.01, "N": 0.02, "s": 0.01, "S": 0.005, "T": 0.002, "L": 0.001, "R": 0.001, "P": 0.001},
}
STAY = 0.8
ROUNDS = 3
#: A page is flagged when more than this share of its words lies in links, tags and menus: its larger part.
THRESHOLD = 0.5

_URL = re.compile(r"(?:https?://|www\.)\S+|(?<![\w@.])(?:[a-z0-9-]{2,}\.)+[a-z]{2,12}(?:/\S*)?(?![\w.])|!?\[[^\]]*\]\([^)\s]*\)|<a\s[^>]*>.*?</a>", re.I | re.S)
_TAGS = re.compile(r"<[^<>]{1,300}>")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+(?:[.,]\d+)*")
_HAN = re.compile(r"[㐀-鿿぀-ヿ가-힯]")
_SEPARATOR = re.compile(r"\s*[,;|·•★☆>»→,、，；/]+\s*|\s+[-–—]\s+|#|\t+|\s{2,}")
# a stop with the blanks after it, if any; the stop comes first, as the search for a mark is quick
_END = re.compile(r"[.!?。！？…؟۔।]([\"'”’)\]]*\s+)|[。！？]")
_PLAIN_END = re.compile(r"[.!?]([\"')\]]*\s+)")
_PRICE = re.compile(r"(?:[$€£¥]\s?\d|\d+[.,]\d{2}\b|-\d+\s?%|\b\d+\s?(?:GB|TB|MB|kg|cm|mm)\b)", re.I)
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s")
_CODE = re.compile(r"^\s*(?:```|def \w+\(|for \w+ in \S+:?$|(?:if|while) .*:\s*$|return\b.{0,40}$|import \w+$|class \w+[(:]|\w+\s*[-+*/]?=\s|\|.*\|\s*$|[{}();]+\s*$|\$\$|\\begin|\\end)")
_INDEX = re.compile(r"^\s*(?:index terms|key\s?words|keywords and phrases|schlagw\w+|mots[- ]cl\w+|palabras clave|关键词|classification|classes|categories|ccs concepts|acm|msc|tags|related|labels?|stichw\w+)\s*[:：—-]", re.I)
_REFERENCE = re.compile(r"^\s*(?:\d+\.\s*)?\[\d+\]\s|^\s*\d+\.\s+[A-Z]\w+\s[A-Z]\.|\b(?:et al\.|doi:|arXiv:)", re.I)
_NOISE = re.compile(r"(.)\1{9,}|(?<!\S)1234567890(?!\S)|(?<![\w/.:-])[A-Za-z0-9+/=]{60,}(?![\w/.:-])", re.S)
_STOP = re.compile(r"[.!?؟۔।](?:[\"'”’)\]\s]|$)|[。！？]")
# the same for lines of ASCII
_PLAIN_STOP = re.compile(r"[.!?](?:[\"')\]\s]|$)")
_PLAIN_WORD = re.compile(r"[a-z]+(?:['\-][a-z]+)*|\d+(?:[.,]\d+)*", re.A)
_INNER = re.compile(r"\.\S")
_DIGIT = re.compile(r"\d")
_SEPARATING = re.compile(r"[,;|·•★☆>»→,、，；/#\t]|\s[-–—]|\s{2}")
_NOT_HAN = re.compile(r"[^㐀-鿿぀-ヿ가-힯]+")

# Frequent function words of the languages of the corpus, by which running text is told from lists.
FUNCTION_WORDS = frozenset(
    """the a an of is are was were be been we our to in and by not it its that which with from for on at as this these those has have had can if when than then they i'll it's
    der die das den dem des und ist wir von zu für mit nicht eine ein einen sind wird werden auf im als auch oder wenn bei sich es
    le la les et est nous une un que dans pour avec sur par plus ne pas des du au aux ce cette qui l'
    el los las y es con para por en se un una del al que no lo más cuando si de""".split()
)


def _sentences(line: str) -> Iterator[str]:
    """The line cut after its stops, without the closing marks and blanks that follow them."""
    at = 0
    for m in (_PLAIN_END if line.isascii() else _END).finditer(line):
        yield line[at : m.start() + 1]
        at = m.end()
    yield line[at:]


def _stops(text: str) -> int:
    """How many sentences end in the text."""
    if text.isascii():
        return len(_PLAIN_STOP.findall(text)) if "." in text or "!" in text or "?" in text else 0
    return len(_STOP.findall(text))


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Lines, and of long lines the sentences, and of what is still long runs of words; and whether it is a whole line."""
    for line in text.splitlines():
        if not line or line.isspace():
            continue
        if len(line) <= 240:
            yield line, True
            continue
        words = line.lower().split()
        n = len(words)
        few = 2.5 * len(set(words)) <= n
        # a long line of few different words, or of short calls, is not cut into sentences, lest they pass for prose
        stuffed = False
        if n >= 20 and (few or 11 * (line.count(".") + line.count("!") + line.count("?")) >= 2 * n):
            ends = _stops(line)
            stuffed = n <= 5.5 * ends or few and (n <= 7 * ends or 4 * len(set(words)) <= n)
        for part in [line] if stuffed else _sentences(line):
            if not part or part.isspace():
                continue
            if len(part) <= 400 and not stuffed:
                yield part, len(part) == len(line)
                continue
            words = part.split(" ")
            if len(words) < 4:
                for at in range(0, len(part), 240):
                    yield part[at : at + 240], False
                continue
            run, size = [], 0
            for w in words:
                run.append(w)
                size += len(w) + 1
                if size > 240:
                    yield " ".join(run), False
                    run, size = [], 0
            if run:
                yield " ".join(run), False


def _size(text: str) -> int:
    """Words of a text; two characters of Chinese, Japanese and Korean make one."""
    han = 0 if text.isascii() else len(_HAN.findall(text))
    return len(_WORD.findall(_HAN.sub(" ", text) if han else text)) + -(-han // 2)


def _noisy(text: str) -> bool:
    """Whether the page may hold noise: a run of ten equal characters, or of 60 without a blank, or of all digits."""
    if "1234567890" in text or max(map(len, text.split()), default=0) >= 60:
        return True
    flat = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # a run of ten holds two neighbours of every fifth character, and all between them
    some = flat[::5]
    at = np.flatnonzero(some[1:] == some[:-1]) * 5
    for i in range(1, 5):
        at = at[flat[at] == flat[at + i]]
    # so few are left that each is looked at: those on the left and right that go on
    for i in at.tolist():
        begin = end = i
        while begin > 0 and end - begin < 9 and flat[begin - 1] == flat[i]:
            begin -= 1
        while end + 1 < len(flat) and end - begin < 9 and flat[end + 1] == flat[i]:
            end += 1
        if end - begin >= 9:
            return True
    return False


def _symbol(line: str, whole: bool) -> tuple[str, int, list[str]]:
    """The symbol of a line, its words in number (those of addresses too), and its content words."""
    plain = line.isascii()
    # each kind of address has one of these marks, so most lines need no search for them
    links = _URL.findall(line) if "://" in line or "](" in line or "<" in line or "." in line[:-1] and _INNER.search(line) else []
    bare = _TAGS.sub(" ", _URL.sub(" ", line)) if links or "<" in line else line
    han = [] if plain else _HAN.findall(bare)
    low = _PLAIN_WORD.findall(bare.lower()) if plain else _WORD.findall((_HAN.sub(" ", bare) if han else bare).lower())
    size = len(low) + -(-len(han) // 2)
    whole_size = _size(line) if links else size
    tokens = low + ["".join(p) for p in zip(han[::2], han[1::2], strict=False)] if han else low
    content = [w for w in tokens if w not in FUNCTION_WORDS]
    if links:
        linked = sum(max(1, _size(x[: x.find("](")] if x.startswith(("[", "!")) else "")) for x in links)
        if linked >= 0.6 * (size + linked) or (len(links) > 2 and size < 3 * len(links)) or size <= 8 and len(han) <= 6 and len(content) == len(tokens) and not _is_reference(line, True):
            return "L", whole_size, content
    return _kind(line, bare, whole, low, han, tokens, content, size), whole_size, content


def _is_reference(line: str, begins: bool) -> bool:
    """Whether the line begins as a reference, or (begins false) has the marks of one."""
    low = line.lower()
    if not (line[:1] == "[" or line[:1].isdigit() or "et al." in low or "doi:" in low or "arxiv:" in low):
        return False
    return bool(_REFERENCE.match(line) if begins else _REFERENCE.search(line))


def _kind(line: str, bare: str, whole: bool, low: list[str], han: list[str], tokens: list[str], content: list[str], size: int) -> str:
    if size == 0:
        return "N"
    digits = _DIGIT.search(line) is not None
    if whole and _CODE.match(line) and not (digits and _PRICE.search(line)):
        return "C"
    running = len(tokens) - len(content)
    distinct = set(tokens)
    ends = _stops(bare)
    repeated, stuffed = 0.0, False
    if len(tokens) - len(distinct) > 1:  # else no word comes three times
        counts = Counter(tokens)
        repeated = sum(n for n in counts.values() if n > 2) / len(tokens)
        often = sorted((n for w, n in counts.items() if w not in FUNCTION_WORDS), reverse=True)
        # a few words make up half of it, or a list or short calls repeat most of their words
        stuffed = len(content) >= 6 and often[0] > 2 and sum(often[:3]) >= 0.5 * len(content)
        if not ends or size <= 7 * ends:
            stuffed |= len(content) >= 6 and sum(n for n in often if n > 2) >= 0.6 * len(content) or len(content) >= 10 and 5 * len(often) <= 2 * len(content)
    if len(han) > 2 and len(han) > 2 * len(low):
        # Chinese: sentences have stops and long runs, lists have blanks or marks between short runs
        runs = [len(r) for r in _NOT_HAN.split(bare) if r]
        if stuffed and len(content) >= 10:
            return "R"
        if max(runs) >= 10 or ends and max(runs) >= 6 or ends and len(runs) <= 4:
            return "S"
        if _HEADING.match(line):
            return "H"
        if _INDEX.match(line) and repeated < 0.5:
            return "K"
        if len(runs) <= 2:
            return "M"
        return "R" if repeated >= 0.5 else "T"
    if (tags := line.count("#")) >= 3 and tags * 6 >= size:
        return "T"
    if size <= 14 and _HEADING.match(line):
        return "H"
    share = running / size
    if size <= 40 and not stuffed and _is_reference(line, False):
        return "Q"
    if stuffed or ends >= 4 and size <= 5.5 * ends:
        return "R"
    if digits and share < 0.1 and size <= 30 and not ends > 1 and _PRICE.search(line):
        return "P"
    if repeated < 0.35 and size <= 80 and _INDEX.match(line):
        return "K"
    if share < (0.12 if ends else 0.45) and len(_SEPARATING.findall(bare)) >= 3:
        separators = len(_SEPARATOR.findall(bare.strip()))
        if separators >= 3 and size / (separators + 1) <= 5 and share < (0.12 if ends else 0.45 if separators >= 5 else 0.3):
            return "R" if repeated >= 0.5 else "T"
    if not ends and size <= 6:
        return "M"
    if share >= 0.12 and size >= 4 or ends and size >= 3 and share > 0:
        return "S" if ends else "s"
    if ends and size >= 3 and repeated < 0.5:
        return "s"
    if size <= 6:
        return "M"
    if not bare.isascii() and share == 0 and _foreign(bare):
        # no function words are known of the script: words that run on without separators and repetition are a sentence's
        return "R" if repeated >= 0.3 else "s"
    return "R" if repeated >= 0.3 else "T" if share < 0.06 else "s"


def _foreign(text: str) -> bool:
    """Whether most letters are of a script other than Latin, Chinese, Japanese and Korean."""
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" and not _HAN.match(c) for c in letters) > len(letters)


#: A page is stuffed if so many of its content words are this share of all of them; then a line is stuffed if half of its own are words that make up so much of the page.
PAGE_WORDS, PAGE_SHARE, WORD_SHARE, PAGE_LEAST = 5, 0.4, 0.05, 40


def observe(text: str | None) -> tuple[str, list[int]]:
    """The symbols of a page's lines and their words in number."""
    pieces = list(_pieces(text or ""))
    seen, sizes, contents = [], [], []
    noisy = bool(pieces) and _noisy(text)
    for piece, whole in pieces:
        s, n, content = _symbol((_NOISE.sub(" ", piece) if noisy else piece).strip(), whole)
        seen.append(s)
        sizes.append(n)
        contents.append(content)
    if len(pieces) > 5:
        # a line that comes again and again
        often = {k for k, n in Counter(p for p, _ in pieces).items() if n > 2}
        if often:
            for i, (piece, _) in enumerate(pieces):
                if seen[i] in "MsTS" and piece in often:
                    seen[i] = "R"
    total = sum(map(len, contents))
    if total >= PAGE_LEAST and ("S" in seen or "s" in seen):
        # if few words make up their share, the others leave no room for more distinct ones than this
        if len(set().union(*contents)) <= PAGE_WORDS + (1 - PAGE_SHARE) * total:
            counts = Counter(w for c in contents for w in c)
            if sum(heapq.nlargest(PAGE_WORDS, counts.values())) >= PAGE_SHARE * total:
                least = max(6, WORD_SHARE * total)
                for i, c in enumerate(contents):
                    if seen[i] in "Ss" and c and 2 * sum(counts[w] >= least for w in c) >= len(c):
                        seen[i] = "R"
    return "".join(seen), sizes


class Hmm:
    """A hidden Markov model of the states over the symbols, in probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls) -> Hmm:
        k, names = len(STATES), list(SYMBOLS)
        move = np.full((k, k), (1 - STAY) / (k - 1))
        np.fill_diagonal(move, STAY)
        emit = np.array([[_START[s][c] for c in names] for s in STATES])
        return cls(np.array([0.6, 0.1, 0.1, 0.1, 0.1]), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def _stacks(sequences: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, codes): the sequences of each length, stacked, so that all take their steps together."""
        by: dict[int, list[int]] = {}
        for i, seen in enumerate(sequences):
            by.setdefault(len(seen), []).append(i)
        for n, at in by.items():
            if n:
                for some in range(0, len(at), 4096):
                    part = at[some : some + 4096]
                    letters = np.frombuffer("".join(sequences[i] for i in part).encode("ascii"), np.uint8)
                    yield np.array(part), _CODE_OF[letters].reshape(len(part), n)

    def expected(self, sequences: list[str], times: np.ndarray) -> np.ndarray:
        """Expected counts, flat: starts, moves, emissions (forward and backward, scaled), each sequence so many times."""
        k, m = len(STATES), len(SYMBOLS)
        start, moves, emit = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
        for at, codes in self._stacks(sequences):
            w = times[at].astype(float)
            n = codes.shape[1]
            b = self.emit.T[codes]
            f, scale = np.empty_like(b), np.empty((len(at), n, 1))
            row = self.start * b[:, 0]
            for t in range(n):
                if t:
                    row = (f[:, t - 1] @ self.move) * b[:, t]
                scale[:, t] = row.sum(1, keepdims=True)
                f[:, t] = row / scale[:, t]
            g = np.ones_like(b)
            for t in range(n - 2, -1, -1):
                g[:, t] = (b[:, t + 1] * g[:, t + 1]) @ self.move.T / scale[:, t + 1]
            post = f * g
            start += w @ post[:, 0]
            if n > 1:
                after = b[:, 1:] * g[:, 1:] / scale[:, 1:] * w[:, None, None]
                moves += self.move * np.einsum("ntj,ntk->jk", f[:, :-1], after)
            np.add.at(emit, codes.ravel(), (post * w[:, None, None]).reshape(-1, k))
        return np.concatenate([start, moves.ravel(), emit.T.ravel()])

    def updated(self, counts: np.ndarray) -> Hmm:
        """The model of the expected counts, with the fixed emissions as a prior of their own weight.

        The prior grows with the counts, so that the states keep their meaning at every size.
        """
        k, m = len(STATES), len(SYMBOLS)
        first = Hmm.initial()
        start, move, emit = counts[:k], counts[k : k + k * k].reshape(k, k), counts[k + k * k :].reshape(k, m)
        mix = lambda c, p: (c / np.maximum(c.sum(-1, keepdims=True), 1e-9) + p) / 2 if c.sum() else p
        return Hmm(mix(start, first.start), mix(move, first.move), mix(emit, first.emit))

    def labels(self, sequences: list[str]) -> list[np.ndarray]:
        """The most probable states of each sequence (Viterbi)."""
        move, emit = np.log(self.move), np.log(self.emit)
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        for at, codes in self._stacks(sequences):
            n = codes.shape[1]
            b = emit.T[codes]
            best = np.log(self.start) + b[:, 0]
            back = np.empty(b.shape, np.int64)
            for t in range(1, n):
                to = best[:, :, None] + move
                back[:, t] = to.argmax(1)
                best = to.max(1) + b[:, t]
            path = np.empty(codes.shape, np.int64)
            path[:, -1] = best.argmax(1)
            rows = np.arange(len(at))
            for t in range(n - 1, 0, -1):
                path[:, t - 1] = back[rows, t, path[:, t]]
            for i, p in zip(at.tolist(), path, strict=True):
                out[i] = p
        return out


_CODE_OF = np.zeros(128, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE_OF[ord(_c)] = _i


def line_symbols(documents: DataFrame) -> DataFrame:
    """doc_id, seen (a symbol per line) and sizes (of the lines) of each distinct document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [observe(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["doc_id", "seen", "sizes"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, seen string, sizes array<int>")


def train(lines: DataFrame, rounds: int = ROUNDS) -> Hmm:
    """Expectation maximization over all sequences; each round brings one vector of expected counts to the driver.

    The vector has a place per start, move and emission of the model, whatever the size of the corpus.
    Equal sequences are counted first, so that a hot group is one row.
    """
    distinct = spool(lines.where("seen <> ''").groupBy("seen").agg(F.count("*").alias("n")), "sequences")
    model = Hmm.initial()
    width = len(STATES) * (1 + len(STATES) + len(SYMBOLS))
    for _ in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: Hmm = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                total += now.expected(batch.column("seen").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["at", "count"])

        sums = distinct.mapInArrow(run, "at bigint, count double").groupBy("at").agg(F.sum("count").alias("count")).orderBy("at").collect()
        if not sums:
            break
        model = model.updated(np.array([r["count"] for r in sums]))
    return model


def page_shares(documents: DataFrame) -> DataFrame:
    """doc_id, size, and the share of it in links, tags and menu lines, for each document with any word.

    Null and blank texts have no lines and give no row; texts of any length are read whole; repeated
    rows give repeated rows.
    """
    lines = spool(line_symbols(documents), "page-lines")
    model = train(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column("seen").to_pylist()
            distinct = sorted(set(seen))
            path = dict(zip(distinct, model.labels(distinct), strict=True))
            out = np.zeros((len(seen), len(STATES)))
            for i, (s, sizes) in enumerate(zip(seen, batch.column("sizes").to_pylist(), strict=True)):
                if s:
                    out[i] = np.bincount(path[s], sizes, len(STATES))
            total = out.sum(1)
            part = out / np.maximum(total, 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total.astype(np.int64)), *[pa.array(part[:, i]) for i in (1, 2, 3)]], names=["doc_id", "size", "links", "tags", "menu"])

    return lines.mapInArrow(run, "doc_id bigint, size bigint, links double, tags double, menu double").where("size > 0")


def stuffed_pages(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id of the pages whose larger part is keyword stuffing, tags, product lines or link lists. See page_shares."""
    return page_shares(documents).where(F.col("links") + F.col("tags") + F.col("menu") > threshold).select("doc_id").distinct()
