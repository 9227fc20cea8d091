"""Encoding with a public byte-level BPE tokenizer (problem 8).

Method: the distinct words of a batch are encoded together in merge rounds. The symbols of all words lie in
one flat array; in each round the pairs of neighbours are looked up by binary search over the sorted
pair keys, and every word merges its pair of lowest rank wherever it occurs, until no word has a pair to merge.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Where the public vocabulary files lie; every function takes another folder as a parameter.
FOLDER = "/opt/tokenizers"
#: Words whose ids a task keeps, so that frequent words are encoded once per task; beyond it the memory is emptied.
KEPT_WORDS = 400_000

# Fixed value: how the tokenizer cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII only, where the standard module is faster; \s there lacks nothing but has 1c-1f in both.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_ANY = regex.compile(PATTERN)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Bpe:
    """Merge tables of one tokenizer. Ids and ranks of the pairs lie in arrays sorted by pair key."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in _byte_letters()], np.int64)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << 32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.none = len(pairs)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all words one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_words = [], []
        while len(symbols):
            same = word[1:] == word[:-1]
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], self.none)
            # the lowest rank of each word, over its run of neighbours
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, self.none], starts)
            nth = np.cumsum(np.r_[True, word[1:] != word[:-1]]) - 1
            live = lowest[nth] < self.none
            if not live.all():
                done_ids.append(symbols[~live])
                done_words.append(word[~live])
                if not live.any():
                    break
            hit = np.r_[(rank == lowest[nth[:-1]]) & (rank < self.none), False]
            # of overlapping hits (a run such as aaa) every second one counts, from the left
            first = hit & ~np.r_[False, hit[:-1]]
            run = np.flatnonzero(first)
            if len(run) < hit.sum():
                where = np.flatnonzero(hit)
                begun = run[np.searchsorted(run, where, side="right") - 1]
                # hits that touch lie in one run only while they are neighbours
                hit[where[(where - begun) % 2 == 1]] = False
            pos = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[pos] = self.merged[at[pos]]
            keep = live
            keep[pos + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int32), sizes * 0
        ids, of = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.int32), np.bincount(of, minlength=len(words))


_loaded: dict[str, Bpe] = {}


def _load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


#: A text whose pieces between blanks are longer than this on average (as without blanks between words) is cut into words at once.
LONG_PIECE = 24


class Encoder:
    """Encodes texts, each word and each piece between two blanks once while it is remembered.

    A single blank with other characters on both sides always begins a word of the tokenizer, so the ids of
    such a piece, with the blank before it, do not depend on its surroundings. Texts with other white space
    beside a blank are cut into words as a whole.
    """

    def __init__(self, bpe: Bpe) -> None:
        self.bpe = bpe
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(sizes) > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        new = range(self.known, self.known + len(sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[new.start : new.stop] = self.used + np.cumsum(sizes) - sizes
        self.length[new.start : new.stop] = sizes
        self.used += len(ids)
        self.known = new.stop
        return new

    def _ids(self, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.length[which]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(sizes.sum())) + np.repeat(self.begin[which] - (ends - sizes), sizes)]
        return ids, np.diff(np.r_[0, np.r_[0, ends][np.cumsum(counts)]])

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [(_ASCII if t.isascii() else _ANY).findall(t) for t in texts]
        new = list(set().union(*cut).difference(self.words))
        if new:
            self.words.update(zip(new, self._keep(*self.bpe.encode_words([w.encode("utf-8") for w in new])), strict=True))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        return self._ids(which, counts)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one after the other, and how many each text has."""
        if self.known > KEPT_WORDS:
            self.clear()
        cut = [t.split(" ") if t else [] for t in texts]
        whole = [i for i, p in enumerate(cut) if p and len(texts[i]) > LONG_PIECE * len(p)]
        heads = [p[0] if p else "" for p in cut]
        for i in whole:
            cut[i], heads[i] = [], ""
        tails = [p[1:] for p in cut]
        new = list(set().union(*tails).difference(self.pieces))
        if new:
            good = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
            self.pieces.update(dict.fromkeys(new, -1))
            self.pieces.update(zip(good, self._keep(*self._by_words([" " + p for p in good])), strict=True))
        counts = np.fromiter(map(len, tails), np.int64, len(tails))
        which = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(tails)), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(texts)), counts)
        # texts with white space beside a blank, within or after the first piece
        slow = set(of[which < 0].tolist()) | {i for i, h in enumerate(heads) if h and h[-1].isspace()} | set(whole)
        keep = np.ones(len(texts), bool)
        keep[list(slow)] = False
        ids, sizes = self._ids(which[keep[of]], np.where(keep, counts, 0))
        first, first_sizes = self._by_words([h if k else "" for h, k in zip(heads, keep, strict=True)])
        rest, rest_sizes = self._by_words([texts[i] for i in sorted(slow)])
        rest_all = np.zeros(len(texts), np.int64)
        rest_all[sorted(slow)] = rest_sizes
        total = sizes + first_sizes + rest_all
        out = np.empty(int(total.sum()), np.int32)
        starts = np.cumsum(total) - total
        for part, n, shift in ((first, first_sizes, 0), (ids, sizes, first_sizes), (rest, rest_all, 0)):
            ends = np.cumsum(n)
            out[np.arange(len(part)) + np.repeat(starts + shift - (ends - n), n)] = part
        return out, total


#: Characters of text encoded together, so that memory stays bounded for batches of long texts.
CHUNK_CHARS = 2_000_000


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    yield chunk


def encode(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """key and ids, the token ids of each text without special tokens.

    A null or empty text has an empty list. Strings of special tokens in a text are ordinary text. Texts are
    encoded whole, whatever their length; repeated rows are encoded each. Only the named columns are read.
    """
    path = f"{folder}/{tokenizer}.json"
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(_load(path))
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column("text").to_pylist()):
                ids, counts = enc.encode(texts)
                offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["key", "ids"])
                at += len(texts)

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, keys: list[str], text: str, tokenizer: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The keys and n_tokens of each text; null and empty texts have 0."""
    path = f"{folder}/{tokenizer}.json"
    src = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text"))
    fields = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(_load(path))
        for batch in batches:
            counts = [enc.encode(texts)[1] for texts in _chunks(batch.column("__text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(np.concatenate(counts), pa.int64())], names=[*keys, "n_tokens"])

    return src.mapInArrow(run, f"{fields}, n_tokens bigint")
