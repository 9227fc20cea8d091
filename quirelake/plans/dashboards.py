"""Summary, quality and overview queries on the source-record basis and the canonical-entity basis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions.columns import ARXIV_FORMAT, DOI_FORMAT, even_rate, rate, record_kind, shown_authors, snippet, url_access, valid_url
from quirelake.functions.missing import is_missing
from quirelake.plans.base import BASE, ENTITIES, LABELS, MEMBERS, RECORDS, base, entities, labels, members, records, sql_count, sql_missing
from quirelake.plans.registering import Registry
from quirelake.session import table

register = Registry()


def has(c: str) -> Column:
    return ~is_missing(F.col(c))


@register(f"WITH {RECORDS} SELECT count(*) AS n_records, count(DISTINCT venue) AS n_venues, min(year) AS first_year, max(year) AS last_year, count(DISTINCT CASE WHEN list_status = 'final' THEN venue END) AS n_final_venues, count(*) FILTER (WHERE list_status = 'rolling') AS n_rolling, {sql_count('abstract')} AS n_abstracts, {sql_count('doi')} AS n_dois FROM r")
def dash_summary(spark, d):
    r = records(spark, d, "venue", "year", "list_status", "abstract", "doi")
    return r.agg(
        F.count("*").alias("n_records"),
        F.countDistinct("venue").alias("n_venues"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.countDistinct(F.when(F.col("list_status") == "final", F.col("venue"))).alias("n_final_venues"),
        F.count_if(F.col("list_status") == "rolling").alias("n_rolling"),
        F.count_if(has("abstract")).alias("n_abstracts"),
        F.count_if(has("doi")).alias("n_dois"),
    )


@register(f"WITH {RECORDS} SELECT venue, min(venue_type) AS venue_type, count(*) AS n, min(year) AS first_year, max(year) AS last_year, round(100.0 * {sql_count('abstract')} / count(*), 1) AS abstract_rate, round(100.0 * {sql_count('doi')} / count(*), 1) AS doi_rate FROM r GROUP BY venue")
def dash_venues(spark, d):
    r = records(spark, d, "venue", "venue_type", "year", "abstract", "doi")
    n = F.count("*")
    return r.groupBy("venue").agg(F.min("venue_type").alias("venue_type"), n.alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), rate(F.count_if(has("abstract")), n).alias("abstract_rate"), rate(F.count_if(has("doi")), n).alias("doi_rate")).orderBy(F.desc("n"), "venue")


@register(f"WITH {RECORDS} SELECT year, count(*) AS n, count(DISTINCT venue) AS n_venues FROM r GROUP BY year")
def dash_years(spark, d):
    return records(spark, d, "year", "venue").groupBy("year").agg(F.count("*").alias("n"), F.countDistinct("venue").alias("n_venues")).orderBy("year")


_FIELDS = ("authors", "abstract", "doi", "arxiv_id", "paper_url", "pdf_url")


@register(f"WITH {RECORDS}, c AS (SELECT count(*) AS total, " + ", ".join(f"{sql_count(c)} AS {c}" for c in _FIELDS) + " FROM r) " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS present, total - {c} AS missing, round_even(100.0 * {c} / total, 1) AS present_rate FROM c" for c in _FIELDS))
def dash_completeness(spark, d):
    """One pass over the records, unpivoted, where a scan per field would do the same."""
    one = records(spark, d, *_FIELDS).agg(F.count("*").alias("total"), *[F.count_if(has(c)).alias(c) for c in _FIELDS])
    return one.unpivot(["total"], list(_FIELDS), "field", "present").select("field", "present", (F.col("total") - F.col("present")).alias("missing"), even_rate(F.col("present"), F.col("total"), 1).alias("present_rate"))


@register(f"WITH {RECORDS} SELECT source_name, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM r GROUP BY source_name")
def dash_sources(spark, d):
    g = records(spark, d, "source_name").groupBy("source_name").agg(F.count("*").alias("n"))
    return g.join(g.agg(F.sum("n").alias("total"))).select("source_name", "n", rate(F.col("n"), F.col("total")).alias("share"))


_DOI = "lower(trim(doi))"


@register(f"WITH {RECORDS}, g AS (SELECT {_DOI} AS doi, count(DISTINCT record_id) AS n, count(DISTINCT venue) AS v, string_agg(DISTINCT venue, '; ' ORDER BY venue) AS venues FROM r WHERE NOT {sql_missing('doi')} GROUP BY 1) SELECT doi, n, v AS n_venues, venues FROM g WHERE v > 1")
def dash_cross_venue_dois(spark, d):
    g = records(spark, d, "doi", "venue").where(has("doi")).groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.count("*").alias("n"), F.countDistinct("venue").alias("n_venues"), F.array_join(F.sort_array(F.collect_set("venue")), "; ").alias("venues"))
    return g.where("n_venues > 1")


@register(f"WITH {RECORDS}, g AS (SELECT {_DOI} AS doi, count(*) AS n FROM r WHERE NOT {sql_missing('doi')} GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS repeated_dois, sum(n) AS records_with_them, max(n) AS most FROM g")
def dash_repeated_dois(spark, d):
    g = records(spark, d, "doi").where(has("doi")).groupBy(F.lower(F.trim("doi")).alias("doi")).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("repeated_dois"), F.sum("n").alias("records_with_them"), F.max("n").alias("most"))


@register(f"WITH {MEMBERS} SELECT match_method, confidence, decision_status, count(*) AS n_rows, count(DISTINCT entity_id) AS n_entities FROM m GROUP BY 1, 2, 3")
def dash_match_methods(spark, d):
    return members(spark, d, "match_method", "confidence", "decision_status").groupBy("match_method", "confidence", "decision_status").agg(F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("n_entities"))


@register(f"WITH {BASE} SELECT area_id, year, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY year), 1) AS share FROM b GROUP BY area_id, year")
def dash_area_years(spark, d):
    g = base(spark, d).groupBy("area_id", "year").agg(F.count("*").alias("n"))
    return g.withColumn("share", even_rate(F.col("n"), F.sum("n").over(Window.partitionBy("year")), 1))


@register(f"WITH {BASE} SELECT area_id, venue, n, place FROM (SELECT area_id, venue, count(*) AS n, row_number() OVER (PARTITION BY area_id ORDER BY count(*) DESC, venue) AS place FROM b GROUP BY 1, 2) WHERE place <= 3")
def dash_area_top_venues(spark, d):
    g = base(spark, d).groupBy("area_id", "venue").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("area_id").orderBy(F.desc("n"), "venue"))).where("place <= 3")


@register(f"WITH {BASE} SELECT area_id, count(*) AS n, count(DISTINCT venue) AS n_venues, max(year) - min(year) + 1 AS year_count, count(direction_id) AS with_direction, count(*) FILTER (WHERE direction_id IS NULL) AS pending, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS coverage FROM b GROUP BY area_id")
def dash_area_overview(spark, d):
    g = base(spark, d).groupBy("area_id").agg(F.count("*").alias("n"), F.countDistinct("venue").alias("n_venues"), (F.max("year") - F.min("year") + 1).alias("year_count"), F.count("direction_id").alias("with_direction"), F.count_if(F.col("direction_id").isNull()).alias("pending"))
    return g.withColumn("coverage", rate(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


@register(f"WITH {BASE} SELECT a.area_id, y.year, count(b.entity_id) AS n, count(DISTINCT b.venue) AS n_venues FROM (SELECT DISTINCT area_id FROM area_definitions) a CROSS JOIN (SELECT DISTINCT year FROM b) y LEFT JOIN b ON a.area_id = b.area_id AND b.year = y.year GROUP BY 1, 2")
def dash_area_detail_zero_rows(spark, d):
    b = base(spark, d)
    a = table(spark, d, "area_definitions").select("area_id").distinct().join(b.select("year").distinct())  # areas times years
    return a.join(b, ["area_id", "year"], "left").groupBy("area_id", "year").agg(F.count("entity_id").alias("n"), F.countDistinct("venue").alias("n_venues"))


@register(f"WITH {RECORDS}, {ENTITIES}, {LABELS} SELECT r.year, count(*) AS total, count(l.area_id) AS classified, round_even(100.0 * count(l.area_id) / count(*), 2) AS rate, CASE WHEN r.year <= 2025 THEN 'complete_window' ELSE 'incomplete_year' END AS status FROM e JOIN r ON e.canonical_record_id = r.record_id LEFT JOIN l ON l.entity_id = e.entity_id WHERE coalesce(l.is_non_paper, 0) = 0 GROUP BY r.year")
def dash_coverage_by_year(spark, d):
    e = entities(spark, d, "canonical_record_id").join(records(spark, d, "year"), F.col("canonical_record_id") == F.col("record_id"))
    j = e.join(labels(spark, d), "entity_id", "left").where("coalesce(is_non_paper, 0) = 0")
    g = j.groupBy("year").agg(F.count("*").alias("total"), F.count("area_id").alias("classified"))
    return g.select("year", "total", "classified", even_rate(F.col("classified"), F.col("total")).alias("rate"), F.when(F.col("year") <= 2025, "complete_window").otherwise("incomplete_year").alias("status"))


@register(f"WITH {ENTITIES}, {LABELS} SELECT count(*) AS entities, count(*) FILTER (WHERE l.is_non_paper = 1) AS non_papers, count(*) FILTER (WHERE coalesce(l.is_non_paper, 0) = 0) AS research, count(*) FILTER (WHERE l.is_non_paper = 0) AS classified, count(*) FILTER (WHERE l.entity_id IS NULL) AS pending, count(*) FILTER (WHERE l.is_non_paper = 0 AND l.direction_id IS NULL) AS pending_direction FROM (SELECT DISTINCT entity_id FROM e) e LEFT JOIN l ON l.entity_id = e.entity_id")
def dash_corpus(spark, d):
    j = entities(spark, d).join(labels(spark, d).withColumn("labelled", F.lit(True)), "entity_id", "left")
    paper = F.coalesce("is_non_paper", F.lit(0)) == 0
    return j.agg(
        F.count("*").alias("entities"),
        F.count_if(F.col("is_non_paper") == 1).alias("non_papers"),
        F.count_if(paper).alias("research"),
        F.count_if(F.col("is_non_paper") == 0).alias("classified"),
        F.count_if(F.col("labelled").isNull()).alias("pending"),
        F.count_if((F.col("is_non_paper") == 0) & F.col("direction_id").isNull()).alias("pending_direction"),
    )


@register(f"WITH {RECORDS} SELECT venue, year, source_tier, count(*) AS n, count(*) FILTER (WHERE {sql_missing('abstract')}) AS without_abstract FROM r GROUP BY GROUPING SETS ((venue), (year), (source_tier), ())")
def dash_missing_reports(spark, d):
    r = records(spark, d, "venue", "year", "source_tier", "abstract")
    r = r.withColumn("gone", is_missing(F.col("abstract")))
    return r.groupingSets([["venue"], ["year"], ["source_tier"], []], "venue", "year", "source_tier").agg(F.count("*").alias("n"), F.count_if("gone").alias("without_abstract"))


@register(f"WITH {RECORDS} SELECT venue, year, count(*) AS n, count(DISTINCT paper_id) AS n_ids, {sql_count('abstract')} AS n_abstracts, count(DISTINCT source_file) AS n_files FROM r GROUP BY venue, year")
def dash_catalog_summary(spark, d):
    r = records(spark, d, "venue", "year", "paper_id", "abstract", "source_file")
    return r.groupBy("venue", "year").agg(F.count("*").alias("n"), F.countDistinct("paper_id").alias("n_ids"), F.count_if(has("abstract")).alias("n_abstracts"), F.countDistinct("source_file").alias("n_files"))


@register(f"WITH {RECORDS} SELECT venue, count(DISTINCT year) AS n_years, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR) DESC) AS years FROM r GROUP BY venue")
def dash_facets(spark, d):
    return records(spark, d, "venue", "year").groupBy("venue").agg(F.countDistinct("year").alias("n_years"), F.array_join(F.sort_array(F.collect_set(F.col("year").cast("string")), asc=False), ",").alias("years"))


_M1 = f"WITH {RECORDS}, {MEMBERS}"


@register(f"{_M1}, v AS (SELECT m.entity_id, r.venue, r.year, r.record_id, r.title, row_number() OVER (PARTITION BY m.entity_id ORDER BY CASE WHEN list_status = 'final' THEN 0 ELSE 1 END, r.record_id) AS k FROM r JOIN m ON m.record_id = r.record_id WHERE r.venue = 'CAVIR') SELECT entity_id, venue, year, record_id, title FROM v WHERE k = 1")
def win_venue_papers(spark, d):
    """One record of each entity of a venue, final lists first."""
    r = records(spark, d, "venue", "year", "title", "list_status").where("venue = 'CAVIR'")
    j = r.join(members(spark, d), "record_id")
    w = Window.partitionBy("entity_id").orderBy(F.when(F.col("list_status") == "final", 0).otherwise(1), "record_id")
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").select("entity_id", "venue", "year", "record_id", "title")


@register(f"{_M1}, x AS (SELECT m.entity_id, r.record_id, r.venue, r.year FROM m JOIN r ON r.record_id = m.record_id) SELECT venue, year, count(DISTINCT entity_id) AS n_entities, count(*) AS n_records FROM x GROUP BY venue, year")
def join_records_entities(spark, d):
    j = members(spark, d).join(records(spark, d, "venue", "year"), "record_id")
    return j.groupBy("venue", "year").agg(F.countDistinct("entity_id").alias("n_entities"), F.count("*").alias("n_records"))


@register(f"{_M1} SELECT DISTINCT m.entity_id FROM m WHERE EXISTS (SELECT 1 FROM m m2 JOIN r ON r.record_id = m2.record_id WHERE m2.entity_id = m.entity_id AND r.year = 2025) AND EXISTS (SELECT 1 FROM m m2 JOIN r ON r.record_id = m2.record_id WHERE m2.entity_id = m.entity_id AND r.venue = 'CAVIR')")
def join_semi_appearances(spark, d):
    """Entities that appear in a year and (anywhere) at a venue."""
    m = members(spark, d)
    seen = m.join(records(spark, d, "venue", "year"), "record_id")
    return m.select("entity_id").distinct().join(seen.where("year = 2025"), "entity_id", "left_semi").join(seen.where("venue = 'CAVIR'"), "entity_id", "left_semi")


@register(f"WITH {RECORDS}, m AS (SELECT DISTINCT record_id, entity_id, is_canonical FROM entity_memberships) SELECT r.venue, count(*) AS n FROM m JOIN r ON r.record_id = m.record_id WHERE m.is_canonical = 1 GROUP BY r.venue")
def join_canonical_only(spark, d):
    return members(spark, d, "is_canonical").where("is_canonical = 1").join(records(spark, d, "venue"), "record_id").groupBy("venue").agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS}, {ENTITIES} SELECT (SELECT count(*) FROM r WHERE record_id NOT IN (SELECT record_id FROM entity_memberships WHERE record_id IS NOT NULL)) AS records_without_entity, (SELECT count(*) FROM (SELECT DISTINCT entity_id, canonical_record_id FROM e) e WHERE canonical_record_id IS NULL OR canonical_record_id NOT IN (SELECT record_id FROM r)) AS entities_without_record, (SELECT count(DISTINCT entity_id) FROM entity_area_assignments WHERE entity_id NOT IN (SELECT entity_id FROM e)) AS labels_without_entity")
def join_anti_integrity(spark, d):
    r = records(spark, d)
    a = r.join(table(spark, d, "entity_memberships").select("record_id"), "record_id", "left_anti").agg(F.count("*").alias("records_without_entity"))
    e = entities(spark, d, "canonical_record_id")
    b = e.join(r, F.col("canonical_record_id") == r.record_id, "left_anti").agg(F.count("*").alias("entities_without_record"))
    c = table(spark, d, "entity_area_assignments").select("entity_id").where("entity_id IS NOT NULL").distinct().join(e, "entity_id", "left_anti").agg(F.count("*").alias("labels_without_entity"))
    return a.join(b).join(c)


@register(f"{_M1} SELECT entity_id, count(*) AS n, string_agg(CAST(year AS VARCHAR) || ':' || venue || ':' || m.record_id, ';' ORDER BY year, venue, m.record_id) AS appearances FROM m JOIN r ON r.record_id = m.record_id GROUP BY entity_id HAVING count(*) > 1")
def join_nested_appearances(spark, d):
    """Entities of several records with their appearances nested; an entity's appearances are its own rows, however many."""
    j = members(spark, d).join(records(spark, d, "venue", "year"), "record_id")
    g = j.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("year", "venue", "record_id"))).alias("a"))
    return g.where("n > 1").select("entity_id", "n", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["year"], x["venue"], x["record_id"])), ";").alias("appearances"))


_ISSUES = [
    *[("error", "missing_required", c, sql_missing(c)) for c in ("paper_id", "venue", "title", "source_name", "source_url", "source_tier", "verification_status", "list_status")],
    ("error", "invalid_value", "venue_type", "coalesce(venue_type, '') NOT IN ('conference', 'journal')"),
    ("error", "invalid_value", "list_status", "coalesce(list_status, '') NOT IN ('final', 'rolling')"),
    ("error", "invalid_year", "year", "year IS NULL OR year < 2023 OR year > 2027"),
]


@register(f"WITH {RECORDS}, i AS (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{t}' AS issue, '{f}' AS field FROM r WHERE {c}" for s, t, f, c in _ISSUES)
    + f" UNION ALL SELECT 'warning', 'invalid_format', 'doi' FROM r WHERE NOT {sql_missing('doi')} AND NOT regexp_matches(trim(doi), '(?i)^10\\.\\d{{4,9}}/\\S+$')"
    + f" UNION ALL SELECT 'warning', 'invalid_format', 'arxiv_id' FROM r WHERE NOT {sql_missing('arxiv_id')} AND NOT regexp_matches(trim(arxiv_id), '(?i)^(?:\\d{{4}}\\.\\d{{4,5}}|[a-z-]+/\\d{{7}})(?:v\\d+)?$')"
    + "".join(f" UNION ALL SELECT 'warning', 'invalid_url', '{c}' FROM r WHERE trim(coalesce({c}, '')) <> '' AND NOT regexp_matches(trim({c}), '(?i)^https?://[^/?#\\s]+')" for c in ("paper_url", "pdf_url", "source_url"))
    + f" UNION ALL SELECT 'error', 'incomplete_abstract_provenance', 'abstract' FROM r WHERE NOT {sql_missing('abstract')} AND ({' OR '.join(sql_missing(c) for c in ('abstract_source_name', 'abstract_source_url', 'abstract_source_tier', 'abstract_fetched_at'))})"
    + f" UNION ALL SELECT 'error', 'orphan_abstract_provenance', 'abstract' FROM r WHERE {sql_missing('abstract')} AND NOT ({' AND '.join(sql_missing(c) for c in ('abstract_source_name', 'abstract_source_url', 'abstract_source_tier', 'abstract_fetched_at'))})"
    + ") SELECT severity, issue, field, count(*) AS n FROM i GROUP BY 1, 2, 3")
def quality_issues_by_kind(spark, d):
    """Counts of the issues that validation finds, see issues()."""
    r = records(spark, d, *_VALIDATED)
    return issues(r).groupBy("severity", "issue", "field").agg(F.count("*").alias("n"))


_REQUIRED = ("paper_id", "venue", "title", "source_name", "source_url", "source_tier", "verification_status", "list_status")
_PROVENANCE = ("abstract_source_name", "abstract_source_url", "abstract_source_tier", "abstract_fetched_at")
_VALIDATED = (*_REQUIRED, "venue_type", "year", "doi", "arxiv_id", "paper_url", "pdf_url", "abstract", *_PROVENANCE)


def issues(r: DataFrame, first_year: int = 2023, last_year: int = 2027) -> DataFrame:
    """record_id, severity, issue and field of each rule that a record breaks; all rules in one pass over the records."""

    def rule(broken: Column, severity: str, issue: str, field: str) -> Column:
        return F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), F.lit(field).alias("field")))

    some = F.lit(False)
    every = F.lit(True)
    for c in _PROVENANCE:
        some = some | has(c)
        every = every & has(c)
    rules = [
        *[rule(~has(c), "error", "missing_required", c) for c in _REQUIRED],
        rule(~F.col("venue_type").isin("conference", "journal"), "error", "invalid_value", "venue_type"),
        rule(~F.col("list_status").isin("final", "rolling"), "error", "invalid_value", "list_status"),
        rule(~F.col("year").between(first_year, last_year), "error", "invalid_year", "year"),
        rule(has("doi") & ~F.trim("doi").rlike(DOI_FORMAT), "warning", "invalid_format", "doi"),
        rule(has("arxiv_id") & ~F.trim("arxiv_id").rlike(ARXIV_FORMAT), "warning", "invalid_format", "arxiv_id"),
        *[rule(~valid_url(F.col(c)), "warning", "invalid_url", c) for c in ("paper_url", "pdf_url", "source_url")],
        rule(has("abstract") & ~every, "error", "incomplete_abstract_provenance", "abstract"),
        rule(~has("abstract") & some, "error", "orphan_abstract_provenance", "abstract"),
    ]
    return r.select("record_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("i")).select("record_id", "i.severity", "i.issue", "i.field")


@register(f"WITH {RECORDS}, g AS (SELECT venue, year, paper_id, count(*) AS n FROM r WHERE NOT {sql_missing('paper_id')} GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT venue, count(*) AS repeated_ids, sum(n) AS n_records FROM g GROUP BY venue")
def quality_repeated_ids(spark, d):
    g = records(spark, d, "venue", "year", "paper_id").where(has("paper_id")).groupBy("venue", "year", "paper_id").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("venue").agg(F.count("*").alias("repeated_ids"), F.sum("n").alias("n_records"))


# The kinds by themselves, as far as single words and years tell them; the titles are in lower case.
_KIND = """CASE WHEN t IN ('editorial board', 'front cover', 'back cover', 'table of content', 'table of contents', 'front matter', 'blank page', 'preface', 'title tbd', 'ieee computer society has you covered!') THEN 'front_matter'
  WHEN starts_with(t, 'get published in the new ieee open journal') OR regexp_full_match(t, 'publications seek 20[0-9]{2} editors in chief|vis 20[0-9]{2} contents|ieee transactions on [a-z ]+(: 20[0-9]{2} ieee .*)?') THEN 'front_matter'
  WHEN regexp_full_match(t, '(ieee )?(vr|ismar|vis) 20[0-9]{2} (.*(committees?|supercommittee)( members)?( for journal papers)?|(- )?(paper )?reviewers( for journal papers)?)|20[0-9]{2} reviewers list( *<sup>[*]</sup>|[*])?') OR t IN ('vgtc executive committee', 'ieee visualization and graphics technical committee (vgtc)', 'reviewer summary for transactions on image processing') THEN 'committee_or_reviewers'
  WHEN regexp_full_match(t, '(20[0-9]{2} )?(ieee )?vgtc visualization .*award|ieee (vr|ismar) 20[0-9]{2} visualization and graphics technical (committee|community) [(]vgtc[)] statement') THEN 'award_or_statement'
  WHEN regexp_matches(t, '^(guest )?editorial([^a-z0-9_]|$)|^editor[''’]s note([^a-z0-9_]|$)|^preface to the special issue([^a-z0-9_]|$)|(^|[^a-z0-9_])introduction to the special (issue|section)([^a-z0-9_]|$)|^((ieee )?(vr|ismar) 20[0-9]{2} |welcome: )?message from .|^in memoriam: ') OR t = 'farewell and new eic introduction' THEN 'editorial'
  WHEN regexp_matches(t, '^(erratum|errata|corrigendum|correction to)([^a-z0-9_]|$)') THEN 'correction_notice'
  WHEN regexp_matches(t, '^(notice of retraction|retraction notice|retracted)([^a-z0-9_]|$)') THEN 'retraction' ELSE '' END"""


@register(f"WITH {RECORDS}, n AS (SELECT record_id, rtrim(trim(regexp_replace(lower(replace(coalesce(title, ''), '&amp;', '&')), '\\s+', ' ', 'g')), '.') AS t FROM r) SELECT {_KIND} AS kind, count(*) AS n FROM n GROUP BY 1")
def filter_non_papers(spark, d):
    return records(spark, d, "title").groupBy(record_kind(F.col("title")).alias("kind")).agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS}, g AS (SELECT record_id, {sql_missing('abstract')} AS bare, count(*) OVER (PARTITION BY venue, year, lower(trim(title))) AS k FROM r) SELECT CASE WHEN k > 1 THEN 'review_first' WHEN bare THEN 'title_only' ELSE 'with_abstract' END AS queue, count(*) AS n FROM g GROUP BY 1")
def filter_classification_queue(spark, d):
    r = records(spark, d, "venue", "year", "title", "abstract")
    r = r.select("venue", "year", F.lower(F.trim("title")).alias("t"), is_missing(F.col("abstract")).alias("bare"))
    # rows are counted by title and kind before they are shuffled
    kinds = r.groupBy("venue", "year", "t").agg(F.count("*").alias("k"), F.count_if("bare").alias("n_bare"))
    repeated = F.when(F.col("k") > 1, F.col("k")).otherwise(0)
    one_bare = F.when((F.col("k") == 1) & (F.col("n_bare") == 1), 1).otherwise(0)
    sums = kinds.agg(F.sum(repeated).alias("review_first"), F.sum(one_bare).alias("title_only"), F.sum(F.col("k") - repeated - one_bare).alias("with_abstract"))
    return sums.unpivot([], ["review_first", "title_only", "with_abstract"], "queue", "n").where("n > 0")


@register(f"WITH {RECORDS}, h AS (SELECT record_id, lower(regexp_extract(trim(coalesce(pdf_url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM r) SELECT CASE WHEN h = '' THEN 'none' WHEN h = 'arxiv.org' THEN 'open' ELSE 'unspecified' END AS access, count(*) AS n FROM h GROUP BY 1")
def filter_url_access(spark, d):
    return records(spark, d, "pdf_url").groupBy(url_access(F.col("pdf_url")).alias("access")).agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS} SELECT record_id, CASE WHEN length(abstract) > 280 THEN substr(abstract, 1, 280) || '…' ELSE abstract END AS snippet FROM r WHERE NOT {sql_missing('abstract')}")
def text_snippets(spark, d):
    r = records(spark, d, "abstract").where(has("abstract"))
    return r.select("record_id", snippet(F.col("abstract")).alias("snippet"))


@register(f"WITH {RECORDS}, n AS (SELECT record_id, list_filter(list_transform(string_split(replace(coalesce(authors, ''), ' and ', ';'), ';'), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM r) SELECT record_id, array_to_string(a[1:3], '; ') || CASE WHEN len(a) > 3 THEN ' 等' ELSE '' END AS shown FROM n")
def text_shown_authors(spark, d):
    return records(spark, d, "authors").select("record_id", shown_authors(F.col("authors")).alias("shown"))


@register(f"WITH {RECORDS} SELECT year, venue_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY venue_type ORDER BY year) AS running FROM r GROUP BY year, venue_type")
def win_running_totals(spark, d):
    g = records(spark, d, "year", "venue_type").groupBy("year", "venue_type").agg(F.count("*").alias("n"))
    return g.withColumn("running", F.sum("n").over(Window.partitionBy("venue_type").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


@register(f"WITH {RECORDS}, {MEMBERS}, s AS (SELECT m.entity_id, r.record_id, CASE WHEN list_status = 'final' THEN 1 ELSE 0 END AS a, CASE WHEN {sql_missing('abstract')} THEN 0 ELSE 1 END AS b, CASE WHEN {sql_missing('authors')} THEN 0 ELSE 1 END AS c, CASE WHEN {sql_missing('doi')} THEN 0 ELSE 1 END AS g, CASE WHEN {sql_missing('arxiv_id')} THEN 0 ELSE 1 END AS h, CASE WHEN {sql_missing('paper_url')} THEN 0 ELSE 1 END AS i, CASE WHEN {sql_missing('pdf_url')} THEN 0 ELSE 1 END AS j, CASE WHEN source_tier = 'official' THEN 1 ELSE 0 END AS k, CASE WHEN regexp_matches(coalesce(title, ''), '<[^>]+>|&') THEN 0 ELSE 1 END AS t, -year AS y FROM m JOIN r ON r.record_id = m.record_id), o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY a DESC, b DESC, c DESC, g DESC, h DESC, i DESC, j DESC, k DESC, t DESC, y DESC, record_id DESC) AS n FROM s) SELECT entity_id, record_id FROM o WHERE n = 1")
def win_canonical_record(spark, d):
    """The record that stands for each entity, by one max_by over a tuple instead of a sort per entity."""
    r = records(spark, d, "title", "list_status", *_FIELDS, "source_tier", "year")
    return members(spark, d).join(r, "record_id").groupBy("entity_id").agg(F.max_by("record_id", canonical_order()).alias("record_id"))


def canonical_order() -> Column:
    flag = lambda c: c.cast("int")
    markup = F.coalesce(F.col("title"), F.lit("")).rlike("<[^>]+>|&")
    order = ["abstract", "authors", "doi", "arxiv_id", "paper_url", "pdf_url"]
    return F.struct(flag(F.coalesce(F.col("list_status") == "final", F.lit(False))).alias("k0"), *[flag(has(c)).alias(f"k{i}") for i, c in enumerate(order, 1)], flag(F.coalesce(F.col("source_tier") == "official", F.lit(False))).alias("k7"), (-flag(markup)).alias("k8"), (-F.col("year")).alias("k9"), F.col("record_id").alias("k10"))


@register("SELECT release_id, created_at FROM (SELECT DISTINCT release_id, created_at FROM data_releases WHERE status = 'ready') ORDER BY created_at DESC LIMIT 1")
def latest_release(spark, d):
    r = table(spark, d, "data_releases").where("status = 'ready'")
    return r.agg(F.max_by("release_id", "created_at").alias("release_id"), F.max("created_at").alias("created_at"))


