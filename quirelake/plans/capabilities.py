"""The public read-only queries over the canonical-entity basis, and the registry that answers requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.functions.columns import even_rate, snippet
from quirelake.functions.missing import is_missing
from quirelake.plans.base import BASE, COLUMN_OF, ENTITIES, KEYS, LABELS, MEMBERS, RECORDS, Filters, base, entities, labels, members, records, sql_missing
from quirelake.plans.registering import Registry
from quirelake.session import table

register = Registry()
LAST_COMPLETE_YEAR = 2025


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "area_definitions").select("area_id", "name_zh", "name_en", "scope", "sort_order").distinct()


def selected(spark: SparkSession, d: str, filters: dict | Filters | None, *columns: str) -> DataFrame:
    f = filters if isinstance(filters, Filters) else Filters.of(filters)
    return f.apply(base(spark, d, *dict.fromkeys((*columns, *f.needs()))), _definitions(spark, d))


def count_papers(spark: SparkSession, d: str, filters: dict | None = None, group_by: str = "venue") -> DataFrame:
    """key and n of each group, most first, then by key."""
    key = COLUMN_OF[group_by]
    return selected(spark, d, filters).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("key"))


def share(spark: SparkSession, d: str, filters: dict | None, by: str = "year") -> DataFrame:
    """Of each group that the filters leave, its part of the whole group, in one pass."""
    f = Filters.of(filters)
    b = base(spark, d, *f.needs())
    key = F.col(COLUMN_OF[by])
    part = f.apply(b, _definitions(spark, d)).groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    whole = b.groupBy(key.alias("key")).agg(F.count("*").alias("denominator"))
    return part.join(whole, part.key.eqNullSafe(whole.key)).select(part.key.cast("string").alias("key"), "n", "denominator", even_rate(F.col("n"), F.col("denominator")).alias("share_rate")).orderBy("key")


def trend(spark: SparkSession, d: str, filters: dict | None) -> DataFrame:
    """Each year of the corpus with the papers that the filters leave, zero included, and whether the year is complete."""
    f = Filters.of(filters)
    b = base(spark, d, *f.needs())
    part = f.apply(b, _definitions(spark, d)).groupBy("year").agg(F.count("*").alias("n"))
    whole = b.groupBy("year").agg(F.count("*").alias("total"))
    n = F.coalesce("n", F.lit(0))
    return whole.join(part, "year", "left").select("year", n.alias("n"), "total", even_rate(n, F.col("total")).alias("share_rate"), F.when(F.col("year") <= LAST_COMPLETE_YEAR, "complete_window").otherwise("incomplete_year").alias("year_status")).orderBy("year")


def growth(trended: DataFrame) -> DataFrame:
    """first_year, last_year, the change between them and why it is null, over the complete years of a trend."""
    c = trended.where("year_status = 'complete_window'")
    g = c.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("first_n"), F.max_by("n", "year").alias("last_n"), F.count("*").alias("points"))
    rate = F.when((F.col("points") >= 2) & (F.col("first_n") > 0), F.bround((F.col("last_n") - F.col("first_n")) / F.col("first_n"), 4))
    reason = F.when(F.col("points") < 2, "too_few_years").when(F.col("first_n") == 0, "zero_baseline").otherwise("complete_window")
    return g.select("first_year", "last_year", "first_n", "last_n", rate.alias("change_rate"), reason.alias("reason"))


def compare(spark: SparkSession, d: str, groups: dict[str, dict]) -> DataFrame:
    """A row per year with a column of counts per group, zero-filled over the years of any group."""
    if not 2 <= len(groups) <= 4:
        raise ValueError("compare takes two to four groups")
    parts = [selected(spark, d, f).select("year", F.lit(label).alias("label")) for label, f in groups.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("year").pivot("label", list(groups)).count().fillna(0, list(groups)).orderBy("year")


def top_values(spark: SparkSession, d: str, filters: dict | None, field: str = "venue", limit: int = 10) -> DataFrame:
    """The most frequent values with their share of all; a top-k report."""
    s = selected(spark, d, filters)
    counts = s.groupBy(F.col(COLUMN_OF[field]).cast("string").alias("key")).agg(F.count("*").alias("n"))
    total = s.agg(F.count("*").alias("total"))
    return counts.join(total).select("key", "n", even_rate(F.col("n"), F.col("total")).alias("share_rate")).orderBy(F.desc("n"), F.asc_nulls_first("key")).limit(max(1, min(100, limit)))


def cooccurrence(spark: SparkSession, d: str, filters: dict | None, a: str = "area", b: str = "venue", limit: int = 50) -> DataFrame:
    """The most frequent pairs of two fields; ties by the fields."""
    if a == b or a not in KEYS or b not in KEYS:
        raise ValueError("cooccurrence takes two different fields")
    s = selected(spark, d, filters)
    return s.groupBy(F.col(COLUMN_OF[a]).cast("string").alias("a"), F.col(COLUMN_OF[b]).cast("string").alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("a"), F.asc_nulls_first("b")).limit(max(1, min(500, limit)))


def search_papers(spark: SparkSession, d: str, filters: dict | None, sort: str = "year_desc", page: int = 1, page_size: int = 10) -> DataFrame:
    """One page of the entities the filters leave, newest first or by title; ties by title and entity."""
    s = selected(spark, d, filters, "title", "authors", "doi", "arxiv_id", "paper_url", "abstract")
    order = [F.asc_nulls_first("title"), "entity_id"] if sort == "title" else [F.desc("year"), F.asc_nulls_first("title"), "entity_id"]
    size = max(1, min(50, page_size))
    shown = s.select("entity_id", "title", "venue", "year", "area_id", "direction_id", (~is_missing(F.col("abstract"))).alias("has_abstract"))
    return shown.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def sample_papers(spark: SparkSession, d: str, filters: dict | None, limit: int = 5) -> DataFrame:
    """The first page of the search: the newest, not a random sample."""
    return search_papers(spark, d, filters, page_size=max(1, min(20, limit)))


def papers_in_full(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with its canonical record, labels and appearances."""
    e = entities(spark, d, "canonical_record_id", "entity_status")
    seen = members(spark, d).join(records(spark, d, "venue", "year"), "record_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("year", "venue", "record_id"))).alias("appearances"))
    r = records(spark, d, "title", "abstract", "authors", "doi").withColumnRenamed("record_id", "canonical_record_id")
    return e.join(r, "canonical_record_id", "left").join(labels(spark, d), "entity_id", "left").join(seen, "entity_id", "left").select("entity_id", "entity_status", "title", snippet(F.col("abstract"), 600).alias("abstract"), "authors", "doi", "area_id", "direction_id", "appearances")


def get_paper(spark: SparkSession, d: str, entity_id: str) -> DataFrame:
    """One entity of papers_in_full; no row for an unknown id."""
    return papers_in_full(spark, d).where(F.col("entity_id") == entity_id)


def list_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Each area with its papers and those without a second level, zero included; 'other' is no area of its own."""
    n = base(spark, d).groupBy("area_id").agg(F.count("*").alias("n"), F.count_if(F.col("direction_id").isNull()).alias("pending"))
    return _definitions(spark, d).where("area_id <> 'other'").join(n, "area_id", "left").select("area_id", "name_en", "sort_order", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pending", F.lit(0)).alias("pending")).orderBy("sort_order")


@dataclass(frozen=True)
class Capability:
    name: str
    about: str
    run: Callable[..., DataFrame]


CAPABILITIES = {
    c.name: c
    for c in (
        Capability("search_papers", "one page of entities", search_papers),
        Capability("sample_papers", "the newest entities", sample_papers),
        Capability("get_paper", "one entity", get_paper),
        Capability("count_papers", "counts by a key", count_papers),
        Capability("share", "share of each group", share),
        Capability("trend", "counts by year", trend),
        Capability("compare", "groups by year", compare),
        Capability("top_values", "most frequent values", top_values),
        Capability("cooccurrence", "most frequent pairs", cooccurrence),
        Capability("list_taxonomy", "areas with counts", list_taxonomy),
    )
}


def call(spark: SparkSession, d: str, name: str, arguments: dict | None = None) -> dict:
    """The answer to a request as {ok, data, meta} or {ok, error}; it never raises."""
    if name not in CAPABILITIES:
        return {"ok": False, "error": f"unknown capability: {name}"}
    try:
        data = [r.asDict(recursive=True) for r in CAPABILITIES[name].run(spark, d, **(arguments or {})).toLocalIterator()]  # whole; what is long has pages of its own
    except Exception as e:
        return {"ok": False, "error": str(e)}
    return {"ok": True, "data": data, "meta": {"capability": name, "rows": len(data)}}


_B = f"WITH {BASE}"


@register(f"{_B} SELECT venue AS key, count(*) AS n FROM b GROUP BY venue")
def cap_count_by_venue(spark, d):
    return count_papers(spark, d)


@register(f"{_B} SELECT area_id AS key, count(*) AS n FROM b WHERE year IN (2024, 2025) GROUP BY area_id")
def cap_count_by_area(spark, d):
    return count_papers(spark, d, {"years": [2024, 2025]}, "area")


@register(f"{_B} SELECT direction_id AS key, count(*) AS n FROM b GROUP BY direction_id")
def cap_count_by_direction(spark, d):
    return count_papers(spark, d, None, "direction")


@register(f"{_B}, w AS (SELECT year AS key, count(*) AS denominator FROM b GROUP BY year), p AS (SELECT year AS key, count(*) AS n FROM b WHERE area_id = 'vision_recog' GROUP BY year) SELECT CAST(p.key AS VARCHAR) AS key, n, denominator, round_even(100.0 * n / denominator, 2) AS share_rate FROM p JOIN w ON p.key = w.key")
def cap_share(spark, d):
    return share(spark, d, {"area_ids": ["vision_recog"]})


@register(f"{_B}, w AS (SELECT year, count(*) AS total, count(*) FILTER (WHERE area_id = 'language_models') AS n FROM b GROUP BY year) SELECT year, n, total, round_even(100.0 * n / total, 2) AS share_rate, CASE WHEN year <= 2025 THEN 'complete_window' ELSE 'incomplete_year' END AS year_status FROM w")
def cap_trend(spark, d):
    return trend(spark, d, {"area_ids": ["language_models"]})


@register(f"{_B}, w AS (SELECT year, count(*) FILTER (WHERE area_id = 'language_models') AS n FROM b GROUP BY year), c AS (SELECT * FROM w WHERE year <= 2025) SELECT min(year) AS first_year, max(year) AS last_year, arg_min(n, year) AS first_n, arg_max(n, year) AS last_n, CASE WHEN count(*) >= 2 AND arg_min(n, year) > 0 THEN round_even((arg_max(n, year) - arg_min(n, year)) / CAST(arg_min(n, year) AS DOUBLE), 4) END AS change_rate, CASE WHEN count(*) < 2 THEN 'too_few_years' WHEN arg_min(n, year) = 0 THEN 'zero_baseline' ELSE 'complete_window' END AS reason FROM c")
def cap_growth(spark, d):
    return growth(trend(spark, d, {"area_ids": ["language_models"]}))


@register(f"{_B} SELECT year, count(*) FILTER (WHERE area_id = 'text_mining') AS text, count(*) FILTER (WHERE area_id = 'speech_music') AS speech FROM b WHERE area_id IN ('text_mining', 'speech_music') GROUP BY year")
def cap_compare(spark, d):
    return compare(spark, d, {"text": {"area_ids": ["text_mining"]}, "speech": {"area_ids": ["speech_music"]}})


@register(f"{_B} SELECT venue AS key, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_rate FROM b GROUP BY venue ORDER BY n DESC, key LIMIT 10")
def cap_top_venues(spark, d):
    return top_values(spark, d, None)


@register(f"{_B} SELECT area_id AS a, venue AS b, count(*) AS n FROM b GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 50")
def cap_cooccurrence(spark, d):
    return cooccurrence(spark, d, None)


@register(f"{_B} SELECT entity_id, title, venue, year, area_id, direction_id, NOT {sql_missing('abstract')} AS has_abstract FROM b WHERE lower(title) LIKE '%video%' OR lower(abstract) LIKE '%video%' OR lower(authors) LIKE '%video%' ORDER BY year DESC, title NULLS FIRST, entity_id LIMIT 20 OFFSET 20")
def cap_search_page(spark, d):
    return search_papers(spark, d, {"query": "video"}, page=2, page_size=20)


@register(f"{_B} SELECT entity_id, title, venue, year, area_id, direction_id, NOT {sql_missing('abstract')} AS has_abstract FROM b WHERE venue = 'CAVIR' ORDER BY year DESC, title NULLS FIRST, entity_id LIMIT 5")
def cap_sample(spark, d):
    return sample_papers(spark, d, {"venues": ["CAVIR"]})


@register(f"{_B} SELECT area_id AS key, count(*) AS n FROM b WHERE area_id IN (SELECT area_id FROM area_definitions WHERE lower(name_en) LIKE '%learning%' OR lower(name_zh) LIKE '%learning%') AND direction_id IS NULL GROUP BY area_id")
def cap_named_areas_pending(spark, d):
    return count_papers(spark, d, {"area_names": ["learning"], "pending_direction": True}, "area")


@register(f"{_B} SELECT a.area_id, name_en, sort_order, count(b.entity_id) AS n, count(b.entity_id) FILTER (WHERE direction_id IS NULL) AS pending FROM (SELECT DISTINCT area_id, name_en, sort_order FROM area_definitions) a LEFT JOIN b ON a.area_id = b.area_id WHERE a.area_id <> 'other' GROUP BY 1, 2, 3")
def cap_taxonomy(spark, d):
    return list_taxonomy(spark, d)


@register(f"WITH {RECORDS}, {ENTITIES}, {MEMBERS}, {LABELS}, s AS (SELECT m.entity_id, to_json(list({{'year': r.year, 'venue': r.venue, 'record_id': m.record_id}} ORDER BY r.year, r.venue, m.record_id)) AS appearances FROM m JOIN r USING (record_id) GROUP BY 1) SELECT e.entity_id, e.entity_status, r.title, CASE WHEN length(r.abstract) > 600 THEN substr(r.abstract, 1, 600) || '…' ELSE r.abstract END AS abstract, r.authors, r.doi, l.area_id, l.direction_id, s.appearances FROM e LEFT JOIN r ON r.record_id = e.canonical_record_id LEFT JOIN l ON l.entity_id = e.entity_id LEFT JOIN s ON s.entity_id = e.entity_id")
def cap_get_paper(spark, d):
    """Every entity in full, as one plan instead of one request each."""
    return papers_in_full(spark, d).withColumn("appearances", F.to_json("appearances"))
