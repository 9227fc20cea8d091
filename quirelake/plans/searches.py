"""Queries of the full-text operators over the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quirelake.functions.columns import snippet
from quirelake.operators import search as S
from quirelake.plans.base import BASE, ENTITIES, MEMBERS, RECORDS, Filters, base, members, records, sql_tokens
from quirelake.plans.registering import Registry
from quirelake.session import once

register = Registry()


def index_of(spark, d: str) -> S.Index:
    """The index of all records, built once for a table and read by all queries."""
    return S.Index.read(spark, once(spark, d, "fts", "paper_records", lambda at: S.build(records(spark, d, *S.COLUMNS)).write(at)))


_TOK = f"""WITH {RECORDS}, c AS (SELECT record_id, unnest([{', '.join(f"{{'w': {w}, 't': {sql_tokens(c)}}}" for c, w in zip(S.COLUMNS, S.WEIGHTS, strict=True))}]) AS x FROM r),
t AS (SELECT record_id, x.w AS w, unnest(x.t) AS tok FROM c), len AS (SELECT r.record_id, count(tok) AS n FROM r LEFT JOIN t ON t.record_id = r.record_id GROUP BY 1)"""


def _bm25(terms: tuple[str, ...], tail: str) -> str:
    """Ranks by terms as prefixes, all of which must be there, then the tail over h(record_id, rank)."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{_TOK}, o AS (SELECT record_id, g, sum(w) AS f FROM t JOIN (VALUES {values}) q(g, p) ON starts_with(tok, p) GROUP BY 1, 2),
i AS (SELECT g, greatest(ln((d.docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(d.mean) AS mean FROM o, (SELECT count(*) AS docs, avg(n) AS mean FROM len) d GROUP BY g, d.docs),
h AS (SELECT o.record_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len.n / mean))) AS rank FROM o JOIN i USING (g) JOIN len USING (record_id) GROUP BY 1 HAVING count(*) = {len(terms)}) {tail}"""


@register(f"{_TOK} SELECT tok AS token, count(DISTINCT record_id) AS n_records, count(*) AS n_occurrences FROM t GROUP BY 1")
def fts_index_terms(spark, d):
    """The vocabulary: each token with its records and occurrences."""
    p = index_of(spark, d).postings
    return p.groupBy("token").agg(F.countDistinct("record_id").alias("n_records"), F.sum(F.size("places")).alias("n_occurrences"))


@register(_bm25(("video", "generation", "prompts"), "SELECT record_id, round(rank, 6) AS rank FROM h"))
def fts_all_terms(spark, d):
    """BM25 ranks of all records that have every term."""
    return S.search(index_of(spark, d), S.match_of(S.terms_of("video generation from prompts"))).select("record_id", F.round("rank", 6).alias("rank"))


def _entity_hits(spark, d, query: str):
    """Entities that match a query, relaxed if need be, with the best rank of their records."""
    index = index_of(spark, d)
    match, kept, _ = S.relaxed(index, query)
    return S.entity_ranks(S.search(index, match), members(spark, d)), kept


_FACETS = ("venue", "year", "area_id", "direction_id")
_BASE_AFTER = BASE.replace(f"{RECORDS}, ", "", 1)
_ENTITY = f", {MEMBERS}, {_BASE_AFTER}, x AS (SELECT b.*, k.rank FROM b JOIN (SELECT m.entity_id, min(rank) AS rank FROM h JOIN m ON m.record_id = h.record_id GROUP BY 1) k ON k.entity_id = b.entity_id)"


@register(_bm25(("image", "denoising"), f"{_ENTITY}, f AS ({' UNION ALL '.join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY 2" for c in _FACETS)}) SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM f) WHERE k <= 15"))
def fts_entities_with_facets(spark, d):
    """Entities that match a query, counted by venue, year, area and direction in one pass; the 15 most frequent values of each."""
    hits, _ = _entity_hits(spark, d, "image denoising unheardofword")
    b = base(spark, d).join(hits, "entity_id")
    return facets(b, _FACETS, 15)


def facets(rows: DataFrame, columns: tuple[str, ...], most: int) -> DataFrame:
    """facet, value and n of the most frequent values of each column, ties by the value; rows are unpivoted and counted once."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).where("f.value IS NOT NULL")
    n = long.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("k") <= most).drop("k")


@register(_bm25(("tactile", "feedback", "policies"), f"{_ENTITY} SELECT entity_id, round(rank, 6) AS rank, year, title, CASE WHEN length(abstract) > 280 THEN substr(abstract, 1, 280) || '…' ELSE abstract END AS snippet FROM x ORDER BY 2, year DESC, entity_id LIMIT 25"))
def fts_relaxed_page(spark, d):
    """The best 25 entities of a relaxed query, with snippets."""
    hits, _ = _entity_hits(spark, d, "tactile feedback policies unheardofword")
    b = base(spark, d, "title", "abstract").join(hits, "entity_id").withColumn("rank", F.round("rank", 6))
    return b.select("entity_id", "rank", "year", "title", snippet(F.col("abstract")).alias("snippet")).orderBy("rank", F.desc("year"), "entity_id").limit(25)


_PHRASE = f"""p AS (SELECT record_id, list_bool_or([contains(' ' || array_to_string(x, ' ') || ' ', ' text to image generation ') OR contains(' ' || array_to_string(x, ' ') || ' ', ' text to image generations ') for x in [{', '.join(sql_tokens(c) for c in S.COLUMNS)}]]) AS hit FROM r),
a AS (SELECT record_id, list_bool_and([len(list_filter(x, lambda t: starts_with(t, q))) > 0 for q in ['text', 'image', 'generation']]) AS hit FROM (SELECT record_id, flatten([{', '.join(sql_tokens(c) for c in S.COLUMNS)}]) AS x FROM r)),
f AS (SELECT record_id, 'phrase' AS method FROM p WHERE hit AND (SELECT count(*) FROM p WHERE hit) >= 10 UNION ALL SELECT record_id, 'all_terms' FROM a WHERE hit AND (SELECT count(*) FROM p WHERE hit) < 10)"""


@register(f"WITH {RECORDS}, {_PHRASE} SELECT year, count(*) AS n, any_value(method) AS method FROM f JOIN r USING (record_id) GROUP BY year")
def fts_recall_topic(spark, d):
    """Candidates of a topic by year, from the phrase where it is frequent enough."""
    found, method = S.recall(index_of(spark, d), "text-to-image generation")
    return found.join(records(spark, d, "year"), "record_id").groupBy("year").agg(F.count("*").alias("n"), F.lit(method).alias("method"))


def recall_topic(spark, d, query: str, filters: dict | None = None, limit: int = 50) -> dict[str, DataFrame | str]:
    """Candidates of a topic among labelled papers: how they were found, the best of them, and their distributions.

    Keys: method, verification, items (the best limit, 1 to 200), candidate_count, by_year, by_venue and by_area (20 values each).
    A query without tokens of the index is looked for as a substring.
    """
    f = Filters.of(filters)
    b = f.apply(base(spark, d, *dict.fromkeys(("title", *f.needs()))), None)
    if S.terms_of(query):
        found, method = S.recall(index_of(spark, d), query)
    else:
        text = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.strip().lower())) for c in ("title", "abstract", "authors")]
        found = records(spark, d, "title", "abstract", "authors").where((text[0] | text[1] | text[2]) & F.lit(bool(query.strip()))).select("record_id", F.lit(0.0).alias("rank"))
        method = "like-fallback"
    hits = S.entity_ranks(found, members(spark, d))
    c = b.join(hits, "entity_id")
    verified = VERIFIED.get(" ".join(query.lower().split()))
    return {
        "method": method,
        "verification": verified or "unverified",
        "items": c.select("entity_id", "title", "venue", "year", F.round("rank", 6).alias("rank")).orderBy("rank", F.desc("year"), "entity_id").limit(max(1, min(200, limit))),
        "candidate_count": c.agg(F.count("*").alias("candidate_count")),
        **{f"by_{k}": facets(c, (column,), 20).select("value", "n") for k, column in (("year", "year"), ("venue", "venue"), ("area", "area_id"))},
    }


#: Topics whose candidates were verified, by their query in lower case; a configuration of the catalogue.
VERIFIED = {"text-to-image generation": "verified sample"}


@register(f"WITH {_BASE_AFTER.replace(ENTITIES, RECORDS + ', ' + ENTITIES, 1)}, {MEMBERS}, {_PHRASE}, c AS (SELECT DISTINCT b.entity_id, b.year, b.venue, b.area_id FROM f JOIN m ON m.record_id = f.record_id JOIN b ON b.entity_id = m.entity_id), g AS (SELECT 'by_year' AS facet, CAST(year AS VARCHAR) AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'by_venue', venue, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'by_area', area_id, count(*) FROM c GROUP BY 2) SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM g) WHERE k <= 20")
def cap_recall_distributions(spark, d):
    """The distributions of a topic's candidates by year, venue and area."""
    got = recall_topic(spark, d, "text-to-image generation")
    parts = [got[k].select(F.lit(k).alias("facet"), "value", "n") for k in ("by_year", "by_venue", "by_area")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@register(f"WITH {RECORDS} SELECT record_id, CASE WHEN lower(title) LIKE '%robot%' THEN 3 WHEN lower(abstract) LIKE '%robot%' THEN 2 ELSE 1 END AS score FROM r WHERE lower(title) LIKE '%robot%' OR lower(abstract) LIKE '%robot%' OR lower(authors) LIKE '%robot%'")
def like_search(spark, d):
    """Substring search with a score by the field, for texts the index has no tokens of."""
    r = records(spark, d, "title", "abstract", "authors")
    on = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("robot")) for c in ("title", "abstract", "authors")]
    return r.where(on[0] | on[1] | on[2]).select("record_id", F.when(on[0], 3).when(on[1], 2).otherwise(1).alias("score"))


@register(f"WITH {RECORDS} SELECT record_id, paper_id FROM r WHERE paper_id = (SELECT min(paper_id) FROM r WHERE paper_id LIKE '10.%') OR lower(doi) = (SELECT lower(min(paper_id)) FROM r WHERE paper_id LIKE '10.%') OR arxiv_id = (SELECT min(paper_id) FROM r WHERE paper_id LIKE '10.%') ORDER BY record_id LIMIT 20")
def fts_lookup(spark, d):
    r = records(spark, d, "paper_id", "doi", "arxiv_id")
    key = r.where("paper_id LIKE '10.%'").agg(F.min("paper_id")).first()[0]
    return S.lookup(r, key or "").select("record_id", "paper_id")


