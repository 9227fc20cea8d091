"""Duplicates hidden by formatting differences (problem 1).

Method: the parts of a title are its fields; each normalized field-name and value pair is hashed, the
hashes are summed modulo a prime (a commutative multiset hash, so the order of the parts does not
matter and nothing is sorted), records are grouped by that fingerprint, and equality of the fields
themselves, as multisets of any size, is verified against the group's first record.

A title without part marks, as normalized_title has none, may be the parts of a marked one in any order. The two
meet by a commutative hash of their letters, and whether the one is spelled by the parts of the other is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quirelake.functions.missing import doi_key
from quirelake.llm.titles import spells, title_parts
from quirelake.session import spool

_PRIME = (1 << 61) - 1
_MASK = (1 << 60) - 1


def multiset_hash(values: Column, name: str) -> Column:
    """The sum modulo a prime of the hashes of the pairs (field name, value); the order does not matter."""
    return F.aggregate(
        values,
        F.lit(0).cast("bigint"),
        lambda acc, p: F.pmod(acc + F.xxhash64(F.lit(name), p).bitwiseAND(F.lit(_MASK)), F.lit(_PRIME)),
    )


def letters_hash(parts: list[str]) -> int:
    """The same kind of sum over the letters of all parts."""
    total = 0
    for c, n in Counter("".join(parts)).items():
        total += n * (xxhash.xxh64_intdigest(c) & _MASK)
    return total % _PRIME


_KEYS = "record_id string, doi string, block bigint, letters bigint, fields array<string>"


def _title_fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fields: each part of the title with its number among equal parts, so that two titles have the same multiset if they have the same set."""
    strings = pa.list_(pa.string())
    for batch in batches:
        parts = [title_parts(t, n) for t, n in zip(batch.column("title").to_pylist(), batch.column("normalized_title").to_pylist(), strict=True)]
        at = pa.array([i for i, p in enumerate(parts) if p], pa.int32())
        parts = [p for p in parts if p]
        fields = []
        for p in parts:
            seen: Counter[str] = Counter()
            row = []
            for x in p:
                row.append(x if not seen[x] else f"{x}\n{seen[x]}")
                seen[x] += 1
            fields.append(row)
        kept = [batch.column(c).take(at) for c in ("record_id", "doi", "block")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(map(letters_hash, parts), pa.int64()), pa.array(fields, strings)], names=["record_id", "doi", "block", "letters", "fields"])


_LINK = "block bigint, fp bigint, marked bigint"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, fields = batch.column("text").to_pylist(), batch.column("fields").to_pylist()
        at = [i for i, (t, f) in enumerate(zip(texts, fields, strict=True)) if spells(t, [x.split("\n")[0] for x in f])]
        yield batch.take(pa.array(at, pa.int32())).select(["block", "fp", "marked"])


def fingerprints(records: DataFrame) -> DataFrame:
    """record_id, doi, block (venue and year), fp, fields and linked of each record that has a title.

    fp is the fingerprint of the title's fields. A title without part marks that a marked title of its block spells
    takes that one's fingerprint; linked says so. Marked and unmarked titles are made distinct before they meet.
    """
    src = (
        records.where("record_id IS NOT NULL")
        .select("record_id", doi_key(F.col("doi")).alias("doi"), F.xxhash64(F.lit("venue"), F.col("venue"), F.lit("year"), F.col("year")).alias("block"), "title", "normalized_title")
        .mapInArrow(_title_fields, _KEYS)
    )
    keyed = spool(src.withColumn("fp", multiset_hash(F.col("fields"), "title part")), "format-keys")
    marked = keyed.where("size(fields) > 1").groupBy("block", "letters", F.col("fp").alias("marked")).agg(F.min("fields").alias("fields"))
    unmarked = keyed.where("size(fields) = 1").groupBy("block", "letters", "fp").agg(F.min(F.col("fields")[0]).alias("text"))
    links = unmarked.join(marked, ["block", "letters"]).select("block", "fp", "marked", "text", "fields").mapInArrow(_spelled, _LINK).groupBy("block", "fp").agg(F.min("marked").alias("marked"))
    j = keyed.join(links, ["block", "fp"], "left")
    return j.select("record_id", "doi", "block", F.coalesce("marked", "fp").alias("fp"), "fields", F.col("marked").isNotNull().alias("linked"))


def format_duplicate_groups(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of records of one venue and year that differ in formatting only.

    members: see fingerprints; groups: block, fp, keep_id, n_dois, key_fields.
    Groups are aggregated before the shuffle, so a group of any size is one row per task; the join of
    members with their group is on the group, and a hot group is split there by adaptive execution.
    """
    keyed = fingerprints(records)
    per_doi = keyed.groupBy("block", "fp", "doi").agg(F.min("record_id").alias("keep_id"), F.max("record_id").alias("last_id"), F.min_by(F.when(~F.col("linked"), F.col("fields")), F.when(~F.col("linked"), F.col("record_id"))).alias("fields"), F.min(F.when(~F.col("linked"), F.col("record_id"))).alias("of"))
    groups = per_doi.groupBy("block", "fp").agg(F.min("keep_id").alias("keep_id"), F.max("last_id").alias("last_id"), F.count("doi").alias("n_dois"), F.min_by("fields", "of").alias("key_fields")).where("keep_id < last_id").drop("last_id")
    return keyed, groups


def format_duplicates(records: DataFrame) -> DataFrame:
    """keep_id and copy_id of records with the same title apart from formatting.

    Records of one venue and year are copies when their titles (normalized_title where the title is
    missing) have the same parts apart from case, width, spacing, punctuation, invisible characters,
    markup and character references, however many parts there are. Records whose DOIs differ are no copies: a
    group with several DOIs falls apart by DOI, and its records without a DOI, which could belong to either, form a
    group of their own. Records whose fields differ from those of their group's first one, though the fingerprint is the
    same, form groups by the fields themselves. Null titles, venues and years: a null venue or year is a value
    of its own; a record without any title or id gives no row. Repeated rows count once. An empty table gives
    no rows. Only the named columns are read, so further columns may have any name.
    """
    keyed, groups = format_duplicate_groups(records)
    same = F.col("linked") | (F.size("fields") == F.size("key_fields")) & (F.size(F.array_except("fields", "key_fields")) == 0)
    joined = keyed.join(groups, ["block", "fp"]).withColumn("same", same)
    plain = joined.where("n_dois <= 1 AND same AND record_id <> keep_id").select("keep_id", F.col("record_id").alias("copy_id"))
    own = F.when(F.col("same"), F.lit("")).otherwise(F.array_join(F.array_sort("fields"), "\r"))
    split = joined.where("n_dois > 1 OR NOT same").select("block", "fp", own.alias("own"), F.coalesce("doi", F.lit("")).alias("doi"), F.col("record_id").alias("copy_id"))
    per_doi = split.groupBy("block", "fp", "own", "doi").agg(F.min("copy_id").alias("keep_id"))
    by_doi = split.join(per_doi, ["block", "fp", "own", "doi"]).where("copy_id <> keep_id").select("keep_id", "copy_id")
    return plain.unionAll(by_doi).distinct()


def copies_per_title(records: DataFrame) -> DataFrame:
    """One row per record that stands for its copies: keep_id and n_copies (the copies besides it)."""
    return format_duplicates(records).groupBy("keep_id").agg(F.count("*").alias("n_copies"))
