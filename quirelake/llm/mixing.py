"""Mixing sources to target weights (problem 9).

Method: the tokens of each source's distinct texts are packed into blocks of fixed length. Each output shard
draws how many of its slots each source gets: multinomial counts, conditioned on the totals of the sources
by splitting the totals down a binary tree of shards, so that any shard finds its counts and where they begin
by itself. Slots go through pseudorandom permutations of each source's block numbers, one per
pass over the source, and blocks are joined by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions.missing import bare
from quirelake.llm import bpe
from quirelake.session import spool

BLOCK_TOKENS = 1024
SHARD_BLOCKS = 256
#: Tokens of a source that are packed by one task; each such bucket ends with one block that may be shorter.
BUCKET_TOKENS = 1_000_000
MAX_SOURCES = 10_000
#: Buckets whose begins are summed by one task; a source of 10**15 tokens has 10**5 stretches.
STRETCH = 10_000
SEED = 7


def source_key(c: Column) -> Column:
    """A source without case, blanks around and kind of separator."""
    return F.regexp_replace(F.lower(bare(c)), r"[-_\s]+", "_")


@dataclass
class Source:
    name: str
    target: float
    repeats: int
    tokens: int
    blocks: int
    slots: int = 0


def _number(*parts: object) -> int:
    return xxhash.xxh64_intdigest("|".join(map(str, parts)))


def split_counts(totals: list[int], shards: int, shard: int, shard_slots: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(counts, begins): how many slots of the shard each source has, and how many it has in the shards before.

    The totals are divided down the tree of shards; each division is multivariate hypergeometric, which makes
    the counts of the shards multinomial given the totals. Every shard but the last has shard_slots slots.
    """
    counts, begins = np.array(totals, np.int64), np.zeros(len(totals), np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min(int(counts.sum()), (mid - lo) * shard_slots)
        drawn = _hypergeometric(np.random.default_rng(_number(seed, lo, hi)), counts, left)
        if shard < mid:
            counts, hi = drawn, mid
        else:
            begins, counts, lo = begins + drawn, counts - drawn, mid
    return counts, begins


def _hypergeometric(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """A draw of n of the counts, source by source."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        rest -= c
        if n == 0 or c == 0:
            continue
        out[i] = drawn(rng, c, rest, n)
        n -= int(out[i])
    return out


def drawn(rng: np.random.Generator, good: int, bad: int, n: int, widths: float = 40.0) -> int:
    """How many good ones a draw of n from good and bad ones has, at any size: the distribution function is inverted.

    The chances follow from the most likely number by the ratios of neighbours. They are summed as far as they
    count in double precision: 40 standard deviations or all numbers there are.
    """
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    whole = good + bad
    mode = min(max((n + 1) * (good + 1) // (whole + 2), lo), hi)
    spread = (n * (good / whole) * (bad / whole) * ((whole - n) / max(1, whole - 1))) ** 0.5
    reach = int(widths * (spread + 1))
    below, above = max(lo, mode - reach), min(hi, mode + reach)
    # chance(k + 1) / chance(k), the factors being exact in doubles
    k = np.arange(below, above, dtype=np.float64)
    ratio = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    logs -= logs[mode - below]
    total = np.cumsum(np.exp(logs))
    return below + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, above - below))


def permuted(position: np.ndarray, size: int, key: int) -> np.ndarray:
    """The place of each position in a pseudorandom permutation of 0 .. size - 1 (a Feistel network, walked until in range)."""
    if size <= 1:
        return position * 0
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_number(key, r)) for r in range(6)]
    x = position.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo[todo] = x[todo] >= np.uint64(size)
    return x.astype(np.int64)


def wanted(targets: DataFrame) -> DataFrame:
    """source, target_share and max_repeats of each source; of several rows the largest share. A null max_repeats means once."""
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("max_repeats"))
    return t.where("source <> ''").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))


def _encoded(documents: DataFrame, sources: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """doc_id, source and ids of each distinct text of the wanted sources; a text of several belongs to the first."""
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select("doc_id", source_key(F.col("source")).alias("source"), "text").join(sources.select("source"), "source")
    first = docs.groupBy(F.xxhash64("text").alias("h1"), F.md5("text").alias("h2")).agg(F.min(F.struct("source", "doc_id")).alias("first")).select("first.source", "first.doc_id").distinct()
    once = docs.join(first, ["source", "doc_id"], "left_semi").groupBy("source", "doc_id").agg(F.min("text").alias("text"))
    ids = bpe.encode(once.select(F.struct("doc_id", "source").alias("key"), "text"), "key", "text", tokenizer, folder)
    return spool(ids.select("key.doc_id", "key.source", "ids").where("size(ids) > 0"), "mix-ids")


def pack(encoded: DataFrame, length: int = BLOCK_TOKENS) -> DataFrame:
    """source, block, n_tokens and ids: the tokens of each source in blocks numbered from 0.

    A source is cut into buckets of documents by a hash; the blocks of a bucket follow one another, so that
    neither a source nor a bucket of any size is held by a task at once.
    """
    sizes = encoded.groupBy("source").agg(F.sum(F.size("ids")).alias("tokens"))
    of = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("tokens") / BUCKET_TOKENS))
    keyed = encoded.join(F.broadcast(sizes) if sizes.count() <= MAX_SOURCES else sizes, "source").select("source", of.alias("bucket"), "doc_id", "ids")
    per = keyed.groupBy("source", "bucket").agg(F.ceil(F.sum(F.size("ids")) / length).alias("n"))
    # begins are summed in two steps, so that no task holds more than STRETCH buckets, or stretches, of a source
    per = per.withColumn("stretch", F.floor(F.col("bucket") / STRETCH))
    stretches = per.groupBy("source", "stretch").agg(F.sum("n").alias("m"))
    before = stretches.select("source", "stretch", (F.sum("m").over(Window.partitionBy("source").orderBy("stretch")) - F.col("m")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("source", "stretch").orderBy("bucket")) - F.col("n")
    begins = per.withColumn("within", within).join(before, ["source", "stretch"]).select("source", "bucket", (F.col("before") + F.col("within")).alias("begin"))
    parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rest, seq = None, np.zeros(0, np.int32), 0
        rows: list[tuple[str, int, int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int32)
            offsets = pa.array(np.cumsum([0] + [len(r[3]) for r in rows]), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["source", "bucket", "seq", "ids"])
            rows.clear()
            return out

        for batch in batches:
            lists = batch.column("ids")
            for s, b, ids in zip(batch.column("source").to_pylist(), batch.column("bucket").to_pylist(), lists, strict=True):
                if (s, b) != held:
                    if len(rest):
                        rows.append((*held, seq, rest))
                    held, rest, seq = (s, b), np.zeros(0, np.int32), 0
                rest = np.concatenate([rest, ids.values.to_numpy()])
                full = len(rest) // length
                for i in range(full):
                    rows.append((s, b, seq, rest[i * length : (i + 1) * length]))
                    seq += 1
                rest = rest[full * length :]
                if len(rows) >= 1000:
                    yield flush()
        if len(rest):
            rows.append((*held, seq, rest))
        yield flush()

    blocks = keyed.repartition(parts, "source", "bucket").sortWithinPartitions("source", "bucket", "doc_id").select("source", "bucket", "ids").mapInArrow(run, "source string, bucket bigint, seq bigint, ids array<int>")
    numbered = blocks.join(begins, ["source", "bucket"]).select("source", (F.col("begin") + F.col("seq")).alias("block"), F.size("ids").alias("n_tokens"), "ids")
    return spool(numbered, "mix-blocks")


def plan(blocks: DataFrame, sources: DataFrame, total_tokens: int | None = None) -> list[Source]:
    """The sources with the blocks each gives to the mixture.

    Targets are divided by their sum over the sources that have text. Without total_tokens the mixture is
    the largest in which every source reaches its target within its repeats; with it, sources too small for
    their part give what they may.
    """
    have = blocks.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("blocks"))
    rows = sources.join(have, "source", "left").where("target_share > 0 AND max_repeats > 0").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out = [Source(r["source"], r["target_share"], r["max_repeats"], r["tokens"] or 0, r["blocks"] or 0) for r in rows]
    there = [s for s in out if s.blocks]
    whole = sum(s.target for s in there)
    if not there:
        return out
    total = total_tokens if total_tokens is not None else min(s.tokens * s.repeats * whole / s.target for s in there)
    for s in there:
        s.slots = min(s.blocks * s.repeats, round(total * s.target / whole / (s.tokens / s.blocks)))
    return out


def slots(spark, sources: list[Source], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """shard, slot, source, use and block of every slot of the mixture; use counts the passes over the source from 0."""
    totals = [s.slots for s in sources]
    shards = -(-sum(totals) // shard_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                counts, begins = split_counts(totals, shards, shard, shard_blocks, seed)
                of = np.repeat(np.arange(len(totals)), counts)
                nth = np.concatenate([np.arange(b, b + c) for b, c in zip(begins, counts, strict=True)]) if len(of) else np.zeros(0, np.int64)
                use, block = np.zeros_like(nth), np.zeros_like(nth)
                for i, s in enumerate(sources):
                    mine = of == i
                    if mine.any():
                        use[mine] = nth[mine] // s.blocks
                        for u in np.unique(use[mine]).tolist():
                            at = mine & (use == u)
                            block[at] = permuted(nth[at] % s.blocks, s.blocks, _number(seed, s.name, u))
                order = np.random.default_rng(_number(seed, "order", shard)).permutation(len(of))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), shard)), pa.array(np.arange(len(of))), pa.array([sources[i].name for i in of[order]], pa.string()), pa.array(use[order], pa.int64()), pa.array(block[order], pa.int64())], names=["shard", "slot", "source", "use", "block"])

    schema = "shard bigint, slot bigint, source string, use bigint, block bigint"
    return spark.range(shards).withColumnRenamed("id", "shard").mapInArrow(run, schema) if shards else spark.createDataFrame([], schema)


def _mixed(documents: DataFrame, targets: DataFrame, total_tokens: int | None, tokenizer: str, folder: str) -> tuple[DataFrame, DataFrame, list[Source]]:
    sources = wanted(targets)
    blocks = pack(_encoded(documents, sources, tokenizer, folder))
    chosen = plan(blocks, sources, total_tokens)
    return blocks, slots(documents.sparkSession, chosen), chosen


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str = bpe.FOLDER) -> DataFrame:
    """The mixture: shard, slot, source, use, block, n_tokens and ids of each slot.

    No text is used more often than its source's max_repeats: a text that occurs in several documents counts
    once, for the first of its sources. Null, empty and unwanted texts are left out; sources without text
    give nothing; empty tables give no rows.
    """
    blocks, drawn, _ = _mixed(documents, targets, total_tokens, tokenizer, folder)
    return drawn.join(blocks, ["source", "block"]).select("shard", "slot", "source", "use", "block", "n_tokens", "ids")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str = bpe.FOLDER) -> DataFrame:
    """source, target_share, max_repeats, tokens_held, tokens_used, most_uses and reached_share of each wanted source."""
    blocks, drawn, _ = _mixed(documents, targets, total_tokens, tokenizer, folder)
    used = drawn.join(blocks.select("source", "block", "n_tokens"), ["source", "block"]).groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), (F.max("use") + 1).alias("most_uses"))
    held = blocks.groupBy("source").agg(F.sum("n_tokens").alias("tokens_held"))
    whole = used.agg(F.sum("tokens_used").alias("whole"))
    rows = wanted(targets).join(held, "source", "left").join(used, "source", "left").join(whole)
    return rows.select("source", "target_share", "max_repeats", F.coalesce("tokens_held", F.lit(0)).alias("tokens_held"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce(F.col("tokens_used") / F.col("whole"), F.lit(0.0)).alias("reached_share"))
