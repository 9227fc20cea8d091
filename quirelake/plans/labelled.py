"""Queries of label checks, keyword groups, gates and value functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions.values import list_status, not_after, point_id, precise_date
from quirelake.operators import labelling
from quirelake.plans.base import BASE, RECORDS, base, entities, records
from quirelake.plans.registering import Registry
from quirelake.session import table

register = Registry()
_L = "x AS (SELECT DISTINCT entity_id, area_id, area_secondary, is_non_paper FROM entity_area_assignments WHERE entity_id IS NOT NULL), k AS (SELECT DISTINCT entity_id FROM paper_entities)"


@register(f"WITH {_L} SELECT 'unknown_entity' AS rule, count(DISTINCT entity_id) AS n FROM x WHERE entity_id NOT IN (SELECT entity_id FROM k) UNION ALL SELECT 'unknown_area', count(DISTINCT entity_id) FROM x WHERE area_id NOT IN (SELECT area_id FROM area_definitions) UNION ALL SELECT 'several_areas', count(*) FROM (SELECT entity_id FROM x GROUP BY entity_id HAVING count(DISTINCT area_id) > 1) UNION ALL SELECT 'second_equals_first', count(DISTINCT entity_id) FROM x WHERE area_secondary = area_id UNION ALL SELECT 'non_paper_with_area', count(DISTINCT entity_id) FROM x WHERE is_non_paper = 1 AND coalesce(area_id, '') <> 'other' UNION ALL SELECT 'unlabelled_entity', count(*) FROM k WHERE entity_id NOT IN (SELECT entity_id FROM x)")
def label_checks(spark, d):
    return labelling.label_checks(table(spark, d, "entity_area_assignments"), entities(spark, d), table(spark, d, "area_definitions"))


@register("SELECT entity_id, 'confidence' AS field, 'unknown value' AS error FROM (SELECT DISTINCT entity_id, confidence FROM entity_area_assignments) WHERE coalesce(trim(confidence), '') NOT IN ('', 'high', 'medium') UNION ALL SELECT entity_id, 'area_secondary', 'missing' FROM (SELECT DISTINCT entity_id, confidence, area_secondary FROM entity_area_assignments) WHERE coalesce(trim(area_secondary), '') = ''")
def label_row_errors(spark, d):
    a = table(spark, d, "entity_area_assignments").select("entity_id", "confidence", "area_secondary").distinct()
    return labelling.row_errors(a, {"confidence": ("high", "medium")}, ("area_secondary",), {"confidence": 1}, "entity_id")


GROUPS = [("images", r"(?i)image|video|visual"), ("language", r"(?i)language|text|dialogue"), ("graphs", r"(?i)graph|node")]


@register(f"WITH {RECORDS} SELECT CASE WHEN regexp_matches(coalesce(title, ''), '(?i)image|video|visual') THEN 'images' WHEN regexp_matches(coalesce(title, ''), '(?i)language|text|dialogue') THEN 'language' WHEN regexp_matches(coalesce(title, ''), '(?i)graph|node') THEN 'graphs' ELSE 'other' END AS grp, count(*) AS n FROM r GROUP BY 1")
def filter_keyword_groups(spark, d):
    r = records(spark, d, "title")
    return r.groupBy(labelling.first_group(F.coalesce("title", F.lit("")), GROUPS).alias("grp")).agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS}, c AS (SELECT CASE WHEN regexp_matches(title, '(?i)robot') AND regexp_matches(title, '(?i)language') THEN 'both' END AS a, CASE WHEN regexp_matches(title, '(?i)driving') THEN 'driving' END AS b FROM r) SELECT concat_ws('+', a, b) AS reasons, count(*) AS n FROM c WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1")
def filter_candidate_reasons(spark, d):
    t = F.col("title")
    why = labelling.reasons([("both", t.rlike("(?i)robot") & t.rlike("(?i)language")), ("driving", t.rlike("(?i)driving"))])
    return records(spark, d, "title").select(why.alias("reasons")).where("reasons IS NOT NULL").groupBy("reasons").agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS} SELECT source_file, count(DISTINCT venue) AS n_venues, count(DISTINCT year) AS n_years, count(*) AS n FROM r GROUP BY source_file HAVING count(DISTINCT venue) > 1 OR count(DISTINCT year) > 1")
def quality_mixed_files(spark, d):
    return labelling.mixed_files(records(spark, d, "source_file", "venue", "year"))


@register(f"WITH {RECORDS} SELECT CASE WHEN (venue = 'CAVIR' AND year = 2026) OR year < 2026 THEN 'final' ELSE 'rolling' END AS computed, list_status, count(*) AS n FROM r GROUP BY 1, 2")
def quality_list_status(spark, d):
    """The stored list status against the rule."""
    r = records(spark, d, "venue", "year", "list_status")
    return r.groupBy(list_status(F.col("venue"), F.col("year"), 2026, {"CAVIR": {2026}}).alias("computed"), "list_status").agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS}, p AS (SELECT regexp_extract(trim(fetched_at), '^(\\d{{4}}(?:-\\d{{2}}(?:-\\d{{2}})?)?)', 1) AS t FROM r) SELECT substr(t, 1, 7) <= '2025-06' AS before_july, count(*) AS n FROM p WHERE t <> '' GROUP BY 1")
def text_date_cutoff(spark, d):
    """Records fetched not after a month, compared at the precision both dates have."""
    at = precise_date(F.col("fetched_at"))
    r = records(spark, d, "fetched_at").withColumn("at", at).where("at IS NOT NULL")
    return r.groupBy(not_after(F.col("at"), F.array(F.lit(2025), F.lit(6))).alias("before_july")).agg(F.count("*").alias("n"))


@register(f"WITH {BASE}, t AS (SELECT DISTINCT entity_id, coalesce(area_id, '') AS g, unnest(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{{L}}-]+')) AS term FROM b), n AS (SELECT term, g, count(*) AS n FROM t WHERE term <> '' GROUP BY 1, 2) SELECT term, sum(n) AS n, '{{' || string_agg('\"' || g || '\":' || n, ',' ORDER BY g) || '}}' AS by_group, sum(n) = 1 AS once FROM n GROUP BY term")
def label_vocabulary(spark, d):
    """The words of titles with their counts by area."""
    b = base(spark, d, "title").select("area_id", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}-]+"))).alias("term")).where("term <> ''")
    return labelling.vocabulary(b, "term", "area_id").withColumn("by_group", F.to_json("by_group"))


_SHA = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(CAST(doc_id AS VARCHAR)))"


@register(f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, {_SHA} AS h FROM documents)")
def document_point_ids(spark, d):
    """Stable point ids of the documents."""
    return table(spark, d, "documents").select("doc_id", point_id(F.col("doc_id").cast("string")).alias("point_id"))


@register(f"WITH {RECORDS} SELECT l.entity_id, CASE WHEN l.confidence = 'low' THEN 'review' ELSE l.area_id END AS area_id FROM (SELECT entity_id, min(area_id) AS area_id, min(confidence) AS confidence FROM entity_area_assignments WHERE entity_id IS NOT NULL GROUP BY entity_id) l")
def label_overrides(spark, d):
    """Labels of low confidence replaced by an override."""
    a = table(spark, d, "entity_area_assignments").where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("area_id").alias("area_id"), F.min("confidence").alias("confidence"))
    o = a.where("confidence = 'low'").select("entity_id", F.lit("review").alias("area_id"))
    return labelling.overridden(a.select("entity_id", "area_id"), o, "entity_id")
