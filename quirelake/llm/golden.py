"""Best representative of each duplicate group (problem 2).

Method: the fields of the records are unpivoted to long rows (group, field, value, weight); the weights,
source trust times recency decay, are summed per group, field and normalized value; max_by chooses each
field's winner; and the winners are pivoted back to one row per group. Votes are whole numbers, so that their
sums are the same in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quirelake.functions.missing import bare, is_missing, present
from quirelake.session import spool

# Ranks of the catalogue's tiers and statuses, best last; all else is 0.
TIERS = ("third_party_crosschecked", "official_plus_secondary", "official")
STATUSES = ("crosschecked", "verified_official")
#: Trust of a source by the rank of its tier, and the days in which a vote loses half its weight.
TRUST = (0.25, 0.5, 0.75, 1.0)
HALF_LIFE_DAYS = 180.0
NOW = 1_767_225_600.0
#: A full vote; votes are its parts.
VOTE = 1_000_000_000
FILLED = ("authors", "abstract", "doi", "arxiv_id", "paper_url", "pdf_url")
VALUES = ("title", "authors", "abstract", "doi", "arxiv_id", "paper_url", "pdf_url", "track")


def code(c: Column) -> Column:
    """A tier or status without case, blanks and separators."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def rank(c: Column, ranks: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for i, name in enumerate(ranks, 1):
        out = F.when(code(c) == name.replace("_", ""), F.lit(i)).otherwise(out)
    return out


def instant(c: Column) -> Column:
    """Seconds since 1970 of ISO-8601 text; no zone means UTC, a date alone its midnight; 0 where there is none."""
    t = F.regexp_replace(F.upper(bare(c)), r"^(\d{4}-\d{2}-\d{2})[T ]+", "$1 ")
    t = F.regexp_replace(t, r"\s*(Z|UTC|GMT)$", "+00:00")
    t = F.regexp_replace(t, r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    t = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit(" 00:00:00"))).otherwise(t)
    t = F.when(t.rlike(r"[+-]\d{2}:\d{2}$") & (F.length(t) > 16), t).otherwise(F.concat(t, F.lit("+00:00")))
    return F.coalesce(F.try_to_timestamp(t).cast("double"), F.lit(0.0))


def members(records: DataFrame, memberships: DataFrame) -> DataFrame:
    """Distinct records of each entity with their marks: filled, tier, abstract_tier, status, fetched."""
    filled = sum((F.when(is_missing(F.col(c)), 0).otherwise(1) for c in FILLED), F.lit(0))
    marks = records.where("record_id IS NOT NULL").select(
        "record_id",
        filled.alias("filled"),
        rank(F.col("source_tier"), TIERS).alias("tier"),
        rank(F.col("abstract_source_tier"), TIERS).alias("abstract_tier"),
        rank(F.col("verification_status"), STATUSES).alias("status"),
        instant(F.col("fetched_at")).alias("fetched"),
    )
    of = memberships.where("record_id IS NOT NULL AND entity_id IS NOT NULL").select("record_id", "entity_id")
    return of.join(marks, "record_id").distinct()


RESPECTS = ("filled", "tier", "abstract_tier", "status", "fetched")


def vote(tier: Column, fetched: Column) -> Column:
    """Trust times recency decay, in VOTE-ths. The decay is counted from a fixed instant, as only ratios within a group matter."""
    return F.floor(F.lit(VOTE) * F.element_at(F.array(*map(F.lit, TRUST)), tier + 1) * F.pow(F.lit(2.0), F.least(fetched - F.lit(NOW), F.lit(0.0)) / (86400 * HALF_LIFE_DAYS))).cast("bigint")


def elect(votes: DataFrame, group: str, fields: tuple[str, ...], step: float | None = None) -> DataFrame:
    """One row per group with each field's winner, from long rows (group, field, value, shown, weight).

    Votes of one normalized value are summed before the shuffle; the most votes win, ties go to the
    larger value, and the largest of its spellings is shown. With step the values are grades, and the logarithm of a
    value's votes gains step for each grade: a grade higher counts as much as so many times the votes.
    """
    summed = votes.groupBy(group, "field", "value").agg(F.sum("weight").alias("votes"), F.max("shown").alias("shown"))
    order = F.struct("votes", "value") if step is None else F.struct((F.log(F.col("votes") + F.lit(1.0)) + F.lit(step) * F.col("value")).alias("score"), F.col("value"))
    return summed.groupBy(group).agg(*[F.max_by(F.when(F.col("field") == f, F.col("shown")), F.when(F.col("field") == f, order)).alias(f) for f in fields])


def _grade(c: Column, respect: str) -> Column:
    """A respect as a number in which a difference is at least 1; times count in microseconds."""
    return F.round(c * 1_000_000.0) if respect == "fetched" else c.cast("double")


def best_records(records: DataFrame, memberships: DataFrame) -> DataFrame:
    """entity_id and record_id of the record that is best of its entity in every respect.

    The five respects are unpivoted to long rows and one value of each is elected; pivoted back, the winners
    make the profile a representative must have, and the one record that has it stands, if it is then found no worse
    than the best of the entity in any respect. A grade higher counts as much as all rows
    together: a record that is best in each respect has the largest vote of its entity, so its values win whatever
    the number of worse ones, and no such record is lost. Where no record is best in all, votes decide the profile, which none
    or a worse record has, and the last check leaves that out. Entities of one record, or without such a record, give
    no row. Repeated rows count once; members without a record, null ids and empty tables give no row; missing
    tiers, statuses and times are the lowest. Only the named columns are read.
    """
    m = spool(members(records, memberships), "golden-members")
    step = math.log(m.count() + 2.0)
    long = F.explode(F.array(*[F.struct(F.lit(r).alias("field"), _grade(F.col(r), r).alias("value")) for r in RESPECTS]))
    votes = m.select("entity_id", vote(F.col("tier"), F.col("fetched")).alias("weight"), long.alias("v")).select("entity_id", "v.field", "v.value", F.col("v.value").alias("shown"), "weight")
    profile = elect(votes, "entity_id", RESPECTS, step)
    best = _all([F.col(f"p.{r}") == _grade(F.col(f"m.{r}"), r) for r in RESPECTS])
    none_better = _all([F.max(_grade(F.col(f"m.{r}"), r)) == F.first(f"p.{r}") for r in RESPECTS])
    held = m.alias("m").join(profile.alias("p"), "entity_id").groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(best).alias("n_best"), F.max(F.when(best, F.col("m.record_id"))).alias("record_id"), none_better.alias("none_better"))
    return held.where("n > 1 AND n_best = 1 AND none_better").select("entity_id", "record_id")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def surviving_records(records: DataFrame, memberships: DataFrame) -> DataFrame:
    """One built record per entity: for each field the value with the most votes.

    A vote is the trust of the record's source times the decay of its age (half in HALF_LIFE_DAYS).
    Values that differ in case and blanks only vote together. A field without any value is null.
    most_trusted_record_id is the record whose own vote is largest. Values vote by a hash of 128 bits with the record
    that shows them, and only the winners' texts are fetched, so that long texts are not shuffled with each vote.
    Repeated rows count once; null ids and empty tables give no row. Only the named columns are read.
    """
    bare = {c: F.regexp_replace(F.lower(present(F.col(c))), r"\s+", " ") for c in VALUES}
    # of the spellings of a value one is shown, the same at every run
    values = [F.when(present(F.col(c)).isNotNull(), F.struct(F.lit(c).alias("field"), F.md5(bare[c]).alias("value"), F.struct(F.md5(present(F.col(c))).alias("spelling"), F.col("record_id")).alias("shown"))) for c in VALUES]
    each = F.struct(F.lit("record").alias("field"), F.col("record_id").alias("value"), F.struct(F.lit("").alias("spelling"), F.col("record_id")).alias("shown"))
    votes = (
        records.where("record_id IS NOT NULL")
        .select("record_id", vote(rank(F.col("source_tier"), TIERS), instant(F.col("fetched_at"))).alias("weight"), F.filter(F.array(each, *values), lambda v: v.isNotNull()).alias("f"))
        .join(memberships.where("record_id IS NOT NULL AND entity_id IS NOT NULL").select("record_id", "entity_id"), "record_id")
        .groupBy("record_id", "entity_id")
        .agg(F.max_by(F.struct("weight", "f"), "weight").alias("r"))
        .select("entity_id", "r.weight", F.explode("r.f").alias("f"))
        .select("entity_id", "f.field", "f.value", "f.shown", "weight")
    )
    won = spool(elect(votes, "entity_id", ("record", *VALUES)), "survivors")
    source = records.where("record_id IS NOT NULL").groupBy("record_id").agg(*[F.max(present(F.col(c))).alias(c) for c in VALUES])
    wanted = won.select("entity_id", F.explode(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.col(f"{c}.record_id").alias("record_id"))) for c in VALUES]), lambda v: v.isNotNull())).alias("w"))
    wanted = wanted.select("entity_id", "w.record_id", "w.field").groupBy("entity_id", "record_id").agg(F.collect_set("field").alias("fields"))
    texts = wanted.join(source, "record_id").groupBy("entity_id").agg(*[F.max(F.when(F.array_contains("fields", c), F.col(c))).alias(c) for c in VALUES])
    return won.select("entity_id", F.col("record.record_id").alias("most_trusted_record_id")).join(texts, "entity_id", "left")
