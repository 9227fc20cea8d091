"""Queries of the ten problems and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.llm import bpe, components, format_duplicates, golden, history, mixing, names, spam, topics
from quirelake.functions.missing import PLACEHOLDERS
from quirelake.plans.packed_fields import p5_found
from quirelake.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.format_duplicates(table(spark, d, "paper_records"))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies_per_title(table(spark, d, "paper_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return golden.best_records(table(spark, d, "paper_records"), table(spark, d, "entity_memberships"))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return golden.surviving_records(table(spark, d, "paper_records"), table(spark, d, "entity_memberships"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(table(spark, d, "entity_aliases"), "alias_entity_id", "entity_id")


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return topics.assign(*(table(spark, d, n) for n in ("paper_records", "entity_memberships", "entity_area_assignments", "area_definitions")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("record_id", "area_id")


def p4_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many records each area has as first and as second area."""
    return _areas(spark, d).groupBy("area_id").agg(F.count_if(F.col("place") == 1).alias("n_first"), F.count_if(F.col("place") == 2).alias("n_second"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The releases before the newest make the history, one after the other within its key ranges; the newest is deduplicated against its runs."""
    records, releases = table(spark, d, "paper_records"), table(spark, d, "data_releases")
    newest = releases.where("release_id IS NOT NULL AND created_at IS NOT NULL").agg(F.max_by("release_id", golden.instant(F.col("created_at")))).first()[0]
    h = history.History(spark)
    before = h.accept(records.where(F.col("release_id") != newest), releases)
    return before.unionAll(h.accept(records.where(F.col("release_id") == newest), releases, keep=False)).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_names(p5_found(spark, d).select("author"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.stuffed_pages(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_copies, p2_found, p2_survivors, p3_found, p4_found, p4_composition, p6_found, p7_found, p8_ids, p9_mixture, p9_shares, p10_found)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


_LOW = "lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g'))"
_CODE = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '', 'g')"
_MISSING = "({0} IS NULL OR lower(trim({0})) IN (" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + "))"


def _rank(c: str, ranks: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {_CODE.format(c)} = '{r.replace('_', '')}' THEN {i}" for i, r in enumerate(ranks, 1)) + " ELSE 0 END"


_AT = "trim(fetched_at)"
_INSTANT = f"""CASE WHEN {_MISSING.format('fetched_at')} THEN 0 ELSE coalesce(epoch(try_cast(CASE WHEN regexp_matches({_AT}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {_AT} || ' 00:00:00+00:00'
  WHEN regexp_matches({_AT}, '(Z|[+-]\\d{{2}}:?\\d{{2}})$') THEN replace({_AT}, 'Z', '+00:00') ELSE {_AT} || '+00:00' END AS TIMESTAMPTZ)), 0) END"""

# The dominance of problem 2 as pairs within an entity, and the components of problem 3 as a closure: plain, and only for small tables.
_P2 = f"""WITH r AS (SELECT DISTINCT record_id, {' + '.join(f"CASE WHEN {_MISSING.format(c)} THEN 0 ELSE 1 END" for c in golden.FILLED)} AS a,
  {_rank('source_tier', golden.TIERS)} AS b, {_rank('abstract_source_tier', golden.TIERS)} AS c, {_rank('verification_status', golden.STATUSES)} AS d, {_INSTANT} AS e FROM paper_records),
m AS (SELECT DISTINCT m.entity_id, r.* FROM entity_memberships m JOIN r ON r.record_id = m.record_id WHERE m.entity_id IS NOT NULL)
SELECT x.entity_id, x.record_id FROM m x JOIN m y ON x.entity_id = y.entity_id AND x.record_id <> y.record_id GROUP BY x.entity_id, x.record_id
HAVING bool_and(x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND x.d >= y.d AND x.e >= y.e AND (x.a > y.a OR x.b > y.b OR x.c > y.c OR x.d > y.d OR x.e > y.e))"""

_B = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_BARE = f"regexp_replace({{0}}, '^{_B.replace('{', '{{').replace('}', '}}')}+|{_B.replace('{', '{{').replace('}', '}}')}+$', '', 'g')"
_NAMES = "(" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + ")"
_TRUST = "[" + ", ".join(map(str, golden.TRUST)) + "]"


def _field(c: str) -> str:
    bare = _BARE.format(c)
    return f"{{'f': '{c}', 't': CASE WHEN lower({bare}) NOT IN {_NAMES} THEN {bare} END}}"


_P2S = f"""WITH r AS (SELECT DISTINCT * FROM paper_records WHERE record_id IS NOT NULL), m AS (SELECT DISTINCT record_id, entity_id FROM entity_memberships WHERE record_id IS NOT NULL AND entity_id IS NOT NULL),
w AS (SELECT record_id, CAST(floor({golden.VOTE} * {_TRUST}[1 + {_rank('source_tier', golden.TIERS)}] * pow(2.0, least({_INSTANT} - {golden.NOW}, 0.0) / (86400 * {golden.HALF_LIFE_DAYS}))) AS BIGINT) AS weight, unnest([{', '.join(map(_field, golden.VALUES))}, {{'f': 'record', 't': record_id}}]) AS x FROM r),
v AS (SELECT m.entity_id, w.record_id, weight, x.f AS f, x.t AS t, CASE WHEN x.f = 'record' THEN x.t ELSE md5(regexp_replace(lower(x.t), '\\s+', ' ', 'g')) END AS value FROM m JOIN w ON w.record_id = m.record_id WHERE x.t IS NOT NULL),
s AS (SELECT entity_id, f, value, sum(weight) AS votes, arg_max(t, (CASE WHEN f = 'record' THEN '' ELSE md5(t) END, record_id)) AS shown FROM v GROUP BY 1, 2, 3), e AS (SELECT entity_id, f, arg_max(shown, (votes, value)) AS shown FROM s GROUP BY 1, 2)
SELECT entity_id, max(shown) FILTER (WHERE f = 'record') AS most_trusted_record_id, {', '.join(f"max(shown) FILTER (WHERE f = '{c}') AS {c}" for c in golden.VALUES)} FROM e GROUP BY entity_id"""

_P3 = f"""WITH RECURSIVE p AS (SELECT {_LOW.format('alias_entity_id')} AS a, {_LOW.format('entity_id')} AS b FROM entity_aliases), e AS (SELECT a, b FROM p WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM p WHERE a <> '' AND b <> '' AND a <> b),
c AS (SELECT a AS node, a AS seen FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen) SELECT node AS entity_id, min(seen) AS group_id FROM c GROUP BY node"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p2_survivors": _P2S, "p3_found": _P3}
