"""Queries of topics, vectors, evaluation, state and stream operators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions.columns import cosine, unit
from quirelake.functions.missing import is_missing
from quirelake.functions.text import phrase_text_col
from quirelake.functions.values import point_id
from quirelake.operators import evaluation, state, topics, vectors
from quirelake.plans.base import BASE, ENTITIES, LABELS, MEMBERS, RECORDS, base, labels, members, records, sql_missing, sql_phrase, sql_title_key
from quirelake.plans.registering import Registry
from quirelake.session import spool, table
from quirelake.sources import writers
from quirelake.streaming import ingest

register = Registry()

#: A small tree for the invented papers of the test tables.
TOPICS = topics.load_topics(
    [
        {"topic_id": "t_diffusion", "family": "f_generation", "strong": ["latent diffusion", "text-to-image generation"], "weak": ["denoising steps", "prompts"], "threshold": 3, "concrete": True},
        {"topic_id": "t_video", "family": "f_generation", "strong": ["video generation"], "weak": ["storyboard"], "threshold": 3, "concrete": True},
        {"topic_id": "t_graph", "family": "f_graph", "strong": ["graph transformers", "node classification"], "weak": ["edges", "nodes"], "anchors": ["graph"], "threshold": 4},
        {"topic_id": "t_retrieval", "family": "f_search", "strong": ["dense passage retrieval"], "weak": ["queries"], "benchmarks": ["recall at twenty"], "together": [{"all": ["click", "logs"], "weight": 2}], "threshold": 3},
    ]
)
TAGS = [topics.Tag("diffusion", ("latent diffusion", "flow matching")), topics.Tag("graph", ("graph transformers", "message passing")), topics.Tag("retrieval", ("dual encoders", "late interaction scoring"))]


def _texts(spark, d):
    b = base(spark, d, "title", "abstract")
    return b.select("entity_id", "year", phrase_text_col(F.col("title")).alias("title"), phrase_text_col(F.col("abstract")).alias("abstract"))


def _hit(field: str, term: str) -> str:
    return f"contains(' ' || {field} || ' ', ' {term} ')"


def _points(terms: list[str], weight: float) -> str:
    """An array of the points of each term that a text has, doubled in the title."""
    return ", ".join(f"CASE WHEN {_hit('t', w)} THEN {2 * weight} WHEN {_hit('a', w)} THEN {weight} END" for w in terms)


# The four topics of the tree, by their order: their terms written out once more.
_TOPIC = f"""WITH {BASE}, x AS (SELECT entity_id, year, venue, {sql_phrase('title')} AS t, {sql_phrase('abstract')} AS a FROM b),
s AS (SELECT entity_id, 0 AS place, 't_diffusion' AS topic_id, 'f_generation' AS family, true AS concrete, 3 AS threshold, 0 AS bench, [{_points(['latent diffusion', 'text to image generation'], 3.0)}, {_points(['denoising steps', 'prompts'], 1.0)}] AS p FROM x UNION ALL
SELECT entity_id, 1, 't_video', 'f_generation', false, 3, 0, [{_points(['video generation'], 3.0)}, {_points(['storyboard'], 1.0)}] FROM x UNION ALL
SELECT entity_id, 2, 't_graph', 'f_graph', false, 4, 0, CASE WHEN {_hit('t', 'graph')} OR {_hit('a', 'graph')} OR {_hit('t', 'graphs')} OR {_hit('a', 'graphs')} THEN [{_points(['graph transformers', 'node classification'], 3.0)}, {_points(['edges', 'nodes'], 1.0)}] ELSE [] END FROM x UNION ALL
SELECT entity_id, 3, 't_retrieval', 'f_search', false, 3, CASE WHEN {_hit('t', 'recall at twenty')} OR {_hit('a', 'recall at twenty')} THEN 1 ELSE 0 END, [{_points(['dense passage retrieval'], 3.0)}, {_points(['queries'], 1.0)}, CASE WHEN {_hit('t', 'click')} AND {_hit('t', 'logs')} THEN 4.0 WHEN {_hit('a', 'click')} AND {_hit('a', 'logs')} THEN 2.0 END, {_points(['recall at twenty'], 3.0)}] FROM x),
sc AS (SELECT *, coalesce(list_sum(p), 0) AS score, len(list_filter(p, lambda v: v IS NOT NULL)) AS n_ev FROM s), kp AS (SELECT * FROM sc WHERE score >= threshold AND n_ev > 0),
fm AS (SELECT *, coalesce(max(CASE WHEN concrete THEN score END) OVER w, -1) AS bc, coalesce(max(CASE WHEN NOT concrete THEN score END) OVER w, -1) AS bo FROM kp WINDOW w AS (PARTITION BY entity_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, place) AS k, first_value(family) OVER (PARTITION BY entity_id ORDER BY score DESC, place) AS pf FROM fm WHERE concrete OR NOT (bc >= bo AND bc >= 0)),
ex AS (SELECT *, k > 1 AND family <> pf AND n_ev > bench AS extra FROM o), nt AS (SELECT *, count(*) FILTER (WHERE extra) OVER (PARTITION BY entity_id ORDER BY score DESC, place ROWS UNBOUNDED PRECEDING) AS nth FROM ex),
asg AS (SELECT entity_id, topic_id, family, CAST(score AS DOUBLE) AS score, CASE WHEN k = 1 THEN 'primary' ELSE 'extra' END AS role, n_ev FROM nt WHERE k = 1 OR (extra AND nth <= 2))"""


@register(f"{_TOPIC} SELECT entity_id, topic_id, score, role, n_ev AS n_evidence FROM asg")
def topic_assignments(spark, d):
    """Primary and extra topics of the labelled entities."""
    return topics.classify(_texts(spark, d), TOPICS).select("entity_id", "topic_id", "score", "role", F.size("evidence").alias("n_evidence"))


def _first_term(*terms: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hit(f, w)} THEN '{w}:{name}'" for w in terms for f, name in (("t", "title"), ("a", "abstract"))) + " END"


@register(f"WITH {BASE}, x AS (SELECT entity_id, {sql_phrase('title')} AS t, {sql_phrase('abstract')} AS a FROM b), g AS (SELECT entity_id, 'diffusion' AS tag, {_first_term('latent diffusion', 'flow matching')} AS h FROM x UNION ALL SELECT entity_id, 'graph', {_first_term('graph transformers', 'message passing')} FROM x UNION ALL SELECT entity_id, 'retrieval', {_first_term('dual encoders', 'late interaction scoring')} FROM x) SELECT entity_id, tag, split_part(h, ':', 1) AS term, split_part(h, ':', 2) AS field FROM g WHERE h IS NOT NULL")
def topic_tags(spark, d):
    return topics.scan_tags(_texts(spark, d), TAGS)


@register(f"{_TOPIC}, up AS (SELECT *, topic_id AS ancestor_id FROM asg UNION ALL SELECT *, family FROM asg) SELECT ancestor_id, count(DISTINCT entity_id) AS n_entities, count(*) FILTER (WHERE role = 'primary') AS n_primary, round(avg(score), 1) AS mean_score FROM up GROUP BY 1")
def topic_overview(spark, d):
    """Of each topic its entities and mean score, rolled up to its family by the closure of the tree."""
    parents = spark.createDataFrame([(t.topic_id, t.family) for t in TOPICS] + [(f, None) for f in sorted({t.family for t in TOPICS})], "topic_id string, parent_topic_id string")
    closure = topics.ancestors(spark, parents)
    a = topics.classify(_texts(spark, d), TOPICS)
    return a.join(F.broadcast(closure), "topic_id").groupBy("ancestor_id").agg(F.countDistinct("entity_id").alias("n_entities"), F.count_if(F.col("role") == "primary").alias("n_primary"), F.round(F.avg("score"), 1).alias("mean_score"))


@register(f"{_TOPIC}, y AS (SELECT year, count(*) AS total FROM x GROUP BY 1) SELECT x.year, topic_id, count(*) AS n, any_value(total) AS total, round_even(100.0 * count(*) / any_value(total), 1) AS share FROM asg JOIN x USING (entity_id) JOIN y ON y.year = x.year WHERE role = 'primary' GROUP BY 1, 2")
def topic_trends(spark, d):
    """Primary topics by year with the year's whole as denominator."""
    t = spool(_texts(spark, d), "topic-input")
    a = topics.classify(t, TOPICS).where("role = 'primary'").join(t.select("entity_id", "year"), "entity_id")
    whole = t.groupBy("year").agg(F.count("*").alias("total"))
    return a.groupBy("year", "topic_id").agg(F.count("*").alias("n")).join(whole, "year").withColumn("share", F.bround(100.0 * F.col("n") / F.col("total"), 1))


@register(f"{_TOPIC} SELECT x.venue, coalesce(topic_id, 'unclassified') AS bucket, count(DISTINCT x.entity_id) AS n FROM x LEFT JOIN asg ON asg.entity_id = x.entity_id AND role = 'primary' GROUP BY 1, 2")
def topic_venue_mix(spark, d):
    """Entities of each venue by topic, with a bucket for those of none: the buckets of a venue add up to its entities."""
    b = spool(base(spark, d, "title", "abstract"), "mix-input")
    t = b.select("entity_id", phrase_text_col(F.col("title")).alias("title"), phrase_text_col(F.col("abstract")).alias("abstract"))
    a = topics.classify(t, TOPICS).where("role = 'primary'").select("entity_id", "topic_id")
    g = b.select("entity_id", "venue").join(a, "entity_id", "left").groupBy("venue", F.coalesce("topic_id", F.lit("unclassified")).alias("bucket")).agg(F.countDistinct("entity_id").alias("n"))
    return g


@register()
def chunk_documents(spark, d):
    """Sections and paragraphs of all documents, whole."""
    c = vectors.split_documents(table(spark, d, "documents"), 1200)
    return c.select("chunk_id", point_id(F.col("chunk_id")).alias("point_id"), "doc_id", "section", F.length("text").alias("n_chars"))


@register()
def chunk_sections(spark, d):
    """Of each section of a document its first chunk and number of chunks."""
    c = vectors.split_documents(table(spark, d, "documents"), 1200)
    return c.groupBy("doc_id", "section").agg(F.min_by("chunk_id", "place").alias("first_chunk"), F.count("*").alias("n"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@register("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), p AS (SELECT q.id AS query_id, r.id AS id, round(list_cosine_similarity(q.x, r.x), 6) AS score FROM v q, v r WHERE q.id % 20 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM p) SELECT query_id, id, place FROM o WHERE place <= 5")
def vector_nearest(spark, d):
    """The five nearest vectors of every vector whose id is divisible by 20, against all."""
    v = _vectors(spark, d)
    return vectors.nearest(v.where("id % 20 = 0"), v, 5).select("query_id", "id", "place")


@register("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings) SELECT a.id, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM v a, v b WHERE b.id = (SELECT min(id) FROM v) AND a.label = b.label ORDER BY score DESC, a.id LIMIT 10")
def vector_filtered_search(spark, d):
    """The ten nearest to one vector among those of its label."""
    v = _vectors(spark, d)
    one = v.orderBy("id").first()
    return vectors.similar_to(v, list(one["embedding"]), 10, F.col("label") == one["label"]).select("id", F.round("score", 6).alias("score"))


@register("WITH v AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), u AS (SELECT label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v), p AS (SELECT label, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label) SELECT u.label, count(*) AS n, round(avg(list_cosine_similarity(u.x, c.c)), 5) AS cohesion FROM u JOIN c ON c.label = u.label GROUP BY u.label")
def vector_cohesion(spark, d):
    return vectors.cohesion(_vectors(spark, d), "label").select("label", "n", F.round("cohesion", 5).alias("cohesion"))


@register("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings), u AS (SELECT id, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v), q AS (SELECT label, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM q GROUP BY 1, 2), c AS (SELECT label AS center, list(x ORDER BY i) AS c FROM m GROUP BY label), p AS (SELECT id, center, list_cosine_similarity(u.x, c.c) AS s, row_number() OVER (PARTITION BY id ORDER BY list_cosine_similarity(u.x, c.c) DESC, center) AS k FROM u, c), t AS (SELECT id, max(CASE WHEN k = 1 THEN center END) AS center, max(CASE WHEN k = 1 THEN s END) AS s1, max(CASE WHEN k = 2 THEN s END) AS s2 FROM p GROUP BY 1) SELECT id, center, round(s1, 5) AS cosine, round(s1 - s2, 5) AS margin, s1 < 0.55 OR s1 - s2 < 0.02 AS needs_review FROM t")
def vector_assignment(spark, d):
    """Vectors assigned to the nearest label centroid, with the ones that need review."""
    v = _vectors(spark, d)
    c = vectors.centroids(v, "label").select(F.col("label").alias("center"), "centroid")
    return vectors.assigned(v, c).select("id", "center", F.round("cosine", 5).alias("cosine"), F.round("margin", 5).alias("margin"), "needs_review")


@register()
def vector_clusters(spark, d):
    """Clusters within each label."""
    return vectors.clustered(_vectors(spark, d), "label")


@register()
def vector_kmeans_agreement(spark, d):
    """The adjusted Rand index of distributed clusters and labels."""
    v = _vectors(spark, d)
    c = spool(vectors.minibatch_clusters(v, 10), "clusters")
    return evaluation.rand_index(c.join(v.select("id", "label"), "id"), "cluster", "label")


@register("SELECT vec_id AS id, round(list_dot_product(x, x), 5) AS length FROM (SELECT vec_id, list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda y: y / sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE))))) AS x FROM embeddings)")
def vector_unit_norm(spark, d):
    v = _vectors(spark, d).withColumn("u", unit(F.col("embedding")))
    return v.select("id", F.round(cosine(F.col("u"), F.col("u")), 5).alias("length"))


_PAIRS = f"WITH {RECORDS}, {MEMBERS}, {LABELS}, p AS (SELECT area_id AS gold, coalesce(direction_id, area_id) AS pred FROM l WHERE is_non_paper = 0)"


def _label_pairs(spark, d):
    """Labels against their second area, as a pair of labellings to measure."""
    return labels(spark, d).where("is_non_paper = 0").select(F.col("area_id").alias("gold"), F.coalesce("direction_id", "area_id").alias("pred"))


@register(f"{_PAIRS}, g AS (SELECT gold AS label, count(*) AS n_gold, count(*) FILTER (WHERE gold = pred) AS hits FROM p GROUP BY 1), q AS (SELECT pred AS label, count(*) AS n_pred FROM p GROUP BY 1) SELECT label, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, CASE WHEN n_pred > 0 THEN coalesce(hits, 0) / CAST(n_pred AS DOUBLE) END AS precision, CASE WHEN n_gold > 0 THEN hits / CAST(n_gold AS DOUBLE) END AS recall, 2.0 * coalesce(hits, 0) / (coalesce(n_gold, 0) + coalesce(n_pred, 0)) AS f1, coalesce(n_gold, 0) >= 2 AS counted FROM g FULL JOIN q USING (label)")
def eval_class_metrics(spark, d):
    return evaluation.class_metrics(_label_pairs(spark, d), "gold", "pred")


@register(f"{_PAIRS}, o AS (SELECT count(*) AS n, count(*) FILTER (WHERE gold = pred) AS correct FROM p), w AS (SELECT n, correct, correct / CAST(n AS DOUBLE) AS s FROM o) SELECT n, correct, round(s, 4) AS accuracy, round_even(100 * (s + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 1) AS low, round_even(100 * (s + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(s * (1 - s) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 1) AS high FROM w")
def eval_overall(spark, d):
    return evaluation.overall_metrics(_label_pairs(spark, d), "gold", "pred")


@register(f"{_PAIRS}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE gold = pred) AS agree FROM p), c AS (SELECT sum(a.n * b.n) AS chance FROM (SELECT gold AS l, count(*) AS n FROM p GROUP BY 1) a JOIN (SELECT pred AS l, count(*) AS n FROM p GROUP BY 1) b USING (l)) SELECT n, agree, round((agree / CAST(n AS DOUBLE) - chance / (CAST(n AS DOUBLE) * n)) / (1 - chance / (CAST(n AS DOUBLE) * n)), 6) AS kappa FROM t, c")
def eval_kappa(spark, d):
    return evaluation.kappa(_label_pairs(spark, d), "gold", "pred")


@register(f"WITH {RECORDS}, {MEMBERS}, v AS (SELECT m.entity_id, r.venue, count(*) AS n FROM m JOIN r ON r.record_id = m.record_id GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, venue) AS k FROM v) SELECT entity_id, n AS n_most, venue FROM o WHERE k = 1")
def eval_majority_venue(spark, d):
    j = members(spark, d).join(records(spark, d, "venue"), "record_id")
    return evaluation.majority(j, "entity_id", "venue")


@register(f"WITH {BASE}, o AS (SELECT area_id, entity_id, row_number() OVER (PARTITION BY area_id ORDER BY sha256('golden' || chr(0) || entity_id)) AS sample_order FROM b) SELECT area_id, entity_id, sample_order FROM o WHERE sample_order <= 5")
def eval_stratified_sample(spark, d):
    """Five papers of each area by a hash order: a sampling operator, so the limit is the feature."""
    return evaluation.sampled(base(spark, d), ["area_id"], "entity_id", 5, "golden").select("area_id", "entity_id", "sample_order")


@register(f"WITH {BASE}, o AS (SELECT area_id, year, entity_id, row_number() OVER (PARTITION BY area_id, year ORDER BY sha256('rr' || chr(0) || entity_id) DESC) AS k FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY k, year) AS nth FROM o) SELECT area_id, year, entity_id, nth FROM n WHERE nth <= 8")
def eval_round_robin(spark, d):
    return evaluation.round_robin(base(spark, d), ["area_id"], "year", "entity_id", 8, "rr").select("area_id", "year", "entity_id", "nth")


@register("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def state_upsert(spark, d):
    """The latest event of each user and type after merging later events into earlier ones."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    even, odd = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    o = lambda df: df.withColumn("o", F.struct("ts", "event_id"))
    return state.upserted(o(even), o(odd), ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id")


@register("SELECT user_id, count(*) AS n FROM (SELECT user_id, event_type, event_id FROM events) GROUP BY user_id")
def state_insert_absent(spark, d):
    """Events inserted into a snapshot that holds some of them already."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    snapshot = e.where("event_type = 'click' OR event_id % 3 = 0")
    return state.added_if_absent(snapshot, e, ["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS}, a AS (SELECT DISTINCT venue FROM r WHERE year = 2026), b AS (SELECT DISTINCT venue FROM r WHERE year = 2023) SELECT venue, 'new' AS change FROM a WHERE venue NOT IN (SELECT venue FROM b) UNION ALL SELECT venue, 'gone' FROM b WHERE venue NOT IN (SELECT venue FROM a)")
def state_difference(spark, d):
    r = records(spark, d, "venue", "year")
    return state.difference(r.where("year = 2026"), r.where("year = 2023"), "venue")


@register("WITH w AS (SELECT user_id, event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '>') AS history FROM events) SELECT user_id, event_id, coalesce(history, '') AS history FROM w")
def state_history(spark, d):
    """Each event with the three before it of the same user."""
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("o"), F.col("event_type").alias("text"))
    h = state.history_before(e, "user_id", "o", 3)
    return h.select("user_id", "event_id", F.array_join("history", ">").alias("history"))


@register("WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2), n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS number FROM f) SELECT e.event_id, n.number FROM events e JOIN n ON n.user_id = e.user_id AND n.event_type = e.event_type")
def state_ledger(spark, d):
    """Stable numbers of the types of each user by first sight."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return state.ledger(e, "user_id", "o", "event_type").select("event_id", "number")


@register(f"WITH {RECORDS}, {ENTITIES}, p AS (SELECT e.entity_id, r.pdf_url, r.arxiv_id FROM (SELECT DISTINCT entity_id, canonical_record_id FROM e) e JOIN r ON r.record_id = e.canonical_record_id) SELECT CASE WHEN NOT {sql_missing('pdf_url')} THEN 'catalog' WHEN NOT {sql_missing('arxiv_id')} THEN 'arxiv' ELSE 'none' END AS source, count(*) AS n, sum(CASE WHEN NOT {sql_missing('pdf_url')} THEN 3000000 WHEN NOT {sql_missing('arxiv_id')} THEN 1500000 ELSE 0 END) AS bytes FROM p GROUP BY 1")
def state_download_plan(spark, d):
    e = table(spark, d, "paper_entities").select("entity_id", "canonical_record_id").distinct()
    p = e.join(records(spark, d, "pdf_url", "arxiv_id"), F.col("canonical_record_id") == F.col("record_id"))
    return state.download_plan(p).groupBy("source").agg(F.count("*").alias("n"), F.sum("estimated_bytes").alias("bytes"))


@register("WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h) SELECT h.doc_id, CASE WHEN f.first < h.doc_id THEN f.first END AS duplicate_of FROM h JOIN f ON f.h = h.h")
def state_content_duplicates(spark, d):
    """Documents of the same content with the first of them."""
    h = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    return state.content_duplicates(h, "doc_id", "h")


@register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, d):
    """The windowed counts of the stream operator, over the whole table."""
    return ingest.windowed_counts(table(spark, d, "events"))


@register(f"WITH {RECORDS}, {MEMBERS}, k AS (SELECT record_id, {sql_missing('title')} AS gone, {sql_title_key('title')} AS t FROM r), j AS (SELECT m.record_id, m.entity_id, m.is_canonical, k.t FROM m JOIN k USING (record_id)) SELECT CASE WHEN record_id IN (SELECT record_id FROM j) THEN 'exists' WHEN NOT gone AND t IN (SELECT t FROM j WHERE is_canonical = 1 AND t <> '') THEN 'merged' ELSE 'new' END AS outcome, count(*) AS n FROM k GROUP BY 1")
def stream_ingest_outcomes(spark, d):
    """Records of the releases as entries against the memberships: how many exist, merge or are new."""
    r = records(spark, d, "title")
    m = members(spark, d, "is_canonical").join(r, "record_id")
    return ingest.outcomes(r, m).groupBy("outcome").agg(F.count("*").alias("n"))


_TEX = "replace(replace(coalesce({0}, ''), '&', '\\&'), '_', '\\_')"
_PEOPLE = "array_to_string(list_filter(list_transform(string_split(coalesce(r.authors, ''), ';'), lambda v: trim(v, ' ')), lambda v: v <> ''), ' and ')"


@register(f"WITH {BASE} SELECT b.entity_id, '@' || CASE r.venue_type WHEN 'journal' THEN 'article' WHEN 'conference' THEN 'inproceedings' ELSE 'misc' END || '{{' || coalesce(nullif(substr(regexp_replace(coalesce(r.title, ''), '[^A-Za-z0-9]+', '', 'g'), 1, 20), ''), 'paper') || right(b.entity_id, 6) || ',' || chr(10) || CASE WHEN coalesce(r.title, '') <> '' THEN '  title = {{' || {_TEX.format('r.title')} || '}},' || chr(10) ELSE '' END || CASE WHEN {_PEOPLE} <> '' THEN '  author = {{' || {_TEX.format(_PEOPLE)} || '}},' || chr(10) ELSE '' END || '  year = {{' || r.year || '}},' || chr(10) || CASE WHEN coalesce(r.doi, '') <> '' THEN '  doi = {{' || r.doi || '}},' || chr(10) ELSE '' END || CASE WHEN coalesce(r.paper_url, '') <> '' THEN '  url = {{' || r.paper_url || '}},' || chr(10) ELSE '' END || '  ' || CASE r.venue_type WHEN 'journal' THEN 'journal' ELSE 'booktitle' END || ' = {{' || {_TEX.format('r.venue')} || '}}' || chr(10) || '}}' AS entry FROM b JOIN r ON r.record_id = b.record_id")
def export_bibtex(spark, d):
    """BibTeX entries of all labelled papers."""
    p = base(spark, d, "title", "authors", "venue_type", "doi", "paper_url")
    return writers.bibtex(p)


@register(f"WITH {BASE} SELECT entity_id, '- ' || title || ' — ' || coalesce(authors, '') || ' (' || venue || ', ' || CAST(year AS VARCHAR) || ')' AS entry FROM b")
def export_markdown(spark, d):
    p = base(spark, d, "title", "authors").withColumn("paper_url", F.lit(""))
    return writers.markdown(p)


@register(f"SELECT lang_missing, count(*) AS n FROM (SELECT {sql_missing('lang')} AS lang_missing FROM documents) GROUP BY 1")
def documents_by_missing_language(spark, d):
    return table(spark, d, "documents").groupBy(is_missing(F.col("lang")).alias("lang_missing")).agg(F.count("*").alias("n"))


