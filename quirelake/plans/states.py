"""Queries of the library and of user state. The tables have no downloads or conversations; those are derived from documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quirelake.operators import evaluation, library, matching, search, state, topics, vectors
from quirelake.plans.base import BASE, ENTITIES, MEMBERS, RECORDS, base, entities, labels, members, records, sql_missing
from quirelake.plans.registering import Registry
from quirelake.session import spool, table

register = Registry()


def _papers(spark, d) -> DataFrame:
    """Each entity with documents, and its smallest document."""
    return table(spark, d, "documents").where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("doc_id").alias("k"))


def _sides(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Downloads, parse results, vectors and aliases, made from the number of each paper."""
    w = spool(_papers(spark, d), "library")
    text, tag = F.col("k").cast("string"), F.concat(F.lit("h"), F.col("k").cast("string"))
    downloads = w.select("entity_id", F.when(F.col("k") % 5 == 0, "failed").when(F.col("k") % 5 == 1, "duplicate").otherwise("success").alias("status"), F.when(F.col("k") % 2 == 0, "catalog").otherwise("arxiv").alias("source"), (F.col("k") % 7 != 0).alias("file_exists"), text.alias("updated_at"), F.when(F.col("k") % 5 == 1, F.floor(F.col("k") / 8).cast("string")).otherwise(text).alias("sha256"))
    parsed = w.where("k % 4 <> 0").select("entity_id", F.when(F.col("k") % 11 == 0, "failed").otherwise("success").alias("status"), F.when(F.col("k") % 13 != 0, tag).alias("file_hash"), tag.alias("parsed_hash"), F.when(F.col("k") % 17 == 0, "old").otherwise(tag).alias("indexed_hash"), F.when(F.col("k") % 19 == 0, "g").otherwise("f").alias("indexed_fingerprint"), (F.col("k") % 6).alias("indexed_chunks"), text.alias("updated_at"))
    stored = w.where("k % 3 <> 0").select("entity_id", (F.col("k") % 6).alias("chunks"))
    first = w.groupBy(F.floor(F.col("k") / 50).alias("g")).agg(F.min("entity_id").alias("current"))
    aliases = w.where("k % 10 = 9").withColumn("g", F.floor(F.col("k") / 50)).join(first, "g").where("entity_id <> current").select(F.col("entity_id").alias("old"), "current")
    return downloads, parsed, stored, aliases


def _items(spark, d) -> DataFrame:
    return spool(library.reconciled(*_sides(spark, d), "f"), "library-items")


_LIB = """WITH w AS (SELECT entity_id, min(doc_id) AS k FROM documents WHERE entity_id IS NOT NULL GROUP BY 1), dl AS (SELECT entity_id, CASE k % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'duplicate' ELSE 'success' END AS status, CASE WHEN k % 2 = 0 THEN 'catalog' ELSE 'arxiv' END AS source, k % 7 <> 0 AS file_exists, CASE WHEN k % 5 = 1 THEN CAST(k // 8 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS sha256, k FROM w),
ps AS (SELECT entity_id, CASE WHEN k % 11 = 0 THEN 'failed' ELSE 'success' END AS status, k % 13 <> 0 AS there, k % 17 = 0 AS old_hash, k % 19 = 0 AS old_pipe, k % 6 AS n, k FROM w WHERE k % 4 <> 0), vs AS (SELECT entity_id, k % 6 AS chunks FROM w WHERE k % 3 <> 0),
al AS (SELECT w.entity_id AS old, f.current FROM w JOIN (SELECT k // 50 AS g, min(entity_id) AS current FROM w GROUP BY 1) f ON f.g = w.k // 50 WHERE w.k % 10 = 9 AND w.entity_id <> f.current),
it AS (SELECT coalesce(al.current, dl.entity_id) AS entity_id, dl.entity_id AS storage_id, dl.status AS pdf_status, dl.source AS pdf_source, CASE WHEN dl.file_exists THEN 'present' WHEN dl.status <> 'failed' THEN 'unverified' ELSE 'missing' END AS pdf_file, coalesce(ps.status, '') AS parse_status, coalesce(ps.status = 'success' AND ps.there, false) AS text_exists,
CASE WHEN coalesce(vs.chunks, 0) > 0 AND ps.status IS NULL THEN 'registry_missing' WHEN coalesce(ps.status, '') <> 'success' THEN CASE WHEN dl.status <> 'failed' THEN 'pdf_only' ELSE '' END WHEN NOT ps.there THEN 'parsed_only' WHEN coalesce(vs.chunks, 0) = 0 THEN 'index_missing' WHEN ps.n <= 0 THEN 'registry_missing' WHEN ps.old_hash OR ps.old_pipe OR coalesce(vs.chunks, 0) <> ps.n THEN 'index_stale' ELSE 'indexed_current' END AS index_status,
coalesce(vs.chunks, 0) AS chunks, coalesce(ps.n, 0) AS indexed_chunks, CAST(dl.k AS VARCHAR) AS updated_at FROM dl LEFT JOIN ps ON ps.entity_id = dl.entity_id LEFT JOIN vs ON vs.entity_id = dl.entity_id LEFT JOIN al ON al.old = dl.entity_id),
se AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY (index_status = 'indexed_current') DESC, text_exists DESC, (pdf_file = 'present') DESC, updated_at DESC, storage_id DESC) AS p, count(*) OVER (PARTITION BY entity_id) AS n_artifacts, sum(chunks) OVER (PARTITION BY entity_id) AS all_chunks, arg_min(index_status, storage_id) FILTER (WHERE index_status IN ('index_stale', 'registry_missing')) OVER (PARTITION BY entity_id) AS unsafe FROM it),
sel AS (SELECT entity_id, storage_id, pdf_status, pdf_source, pdf_file, parse_status, text_exists, CASE WHEN n_artifacts > 1 AND unsafe IS NOT NULL THEN unsafe ELSE index_status END AS index_status, all_chunks AS chunks, indexed_chunks, updated_at, n_artifacts FROM se WHERE p = 1)"""


@register(f"{_LIB} SELECT * FROM it")
def lib_items(spark, d):
    """Downloads, parse results and vectors of each stored paper, reconciled."""
    return _items(spark, d)


@register(f"{_LIB} SELECT * FROM sel")
def lib_papers(spark, d):
    """The artifact that stands for each paper."""
    return library.selected_artifacts(_items(spark, d))


@register(f"{_LIB} SELECT count(*) FILTER (WHERE pdf_status IN ('success', 'duplicate')) AS registered_pdfs, count(*) FILTER (WHERE pdf_file = 'present') AS pdf_files_present, count(*) FILTER (WHERE parse_status = 'success' AND text_exists) AS parsed, count(*) FILTER (WHERE index_status = 'indexed_current') AS indexed_current, count(*) FILTER (WHERE index_status = 'index_stale') AS index_stale, count(*) FILTER (WHERE index_status = 'index_missing') AS index_missing, count(*) FILTER (WHERE index_status = 'registry_missing') AS registry_missing, sum(chunks) AS chunks, coalesce(max(updated_at) FILTER (WHERE index_status = 'indexed_current'), '') AS last_ingest_at FROM sel")
def lib_summary(spark, d):
    return library.library_summary(library.selected_artifacts(_items(spark, d)))


@register(f"{_LIB} SELECT status, count(*) AS n FROM dl GROUP BY 1")
def lib_status_counts(spark, d):
    return library.status_counts(_sides(spark, d)[0])


@register(f"{_LIB} SELECT entity_id, arg_min(storage_id, (CASE pdf_status WHEN 'success' THEN 0 WHEN 'duplicate' THEN 1 ELSE CASE WHEN storage_id = entity_id THEN 2 ELSE 3 END END, storage_id)) AS storage_id FROM it GROUP BY 1")
def lib_storage_ids(spark, d):
    """The id under which each paper's file is looked for."""
    downloads, _, _, aliases = _sides(spark, d)
    return library.storage_choice(library.current_ids(downloads, aliases))


@register(f"{_LIB}, dd AS (SELECT dl.*, CASE WHEN f.first < dl.entity_id THEN f.first END AS duplicate_of FROM dl JOIN (SELECT sha256, min(entity_id) AS first FROM dl GROUP BY 1) f USING (sha256)), x AS (SELECT dd.entity_id, dd.status AS d, duplicate_of, ps.status AS p, CASE WHEN it.index_status = 'indexed_current' THEN 'success' END AS i FROM dd LEFT JOIN ps ON ps.entity_id = dd.entity_id JOIN it ON it.storage_id = dd.entity_id), s AS (SELECT *, CASE WHEN i = 'success' THEN 'indexed' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN p = 'success' THEN 'parsed' WHEN d IN ('success', 'duplicate') THEN 'downloaded' ELSE 'requested' END AS stage FROM x) SELECT entity_id, stage, CASE WHEN (d = 'failed' OR coalesce(p, '') = 'failed') AND stage <> 'indexed' THEN 'failed' WHEN stage IN ('indexed', 'duplicate') THEN 'done' ELSE 'pending' END AS outcome FROM s")
def lib_ingest_results(spark, d):
    """How far each paper came."""
    downloads, parsed, _, _ = _sides(spark, d)
    same = state.content_duplicates(downloads, "entity_id", "sha256")
    done = _items(spark, d).where("index_status = 'indexed_current'").select(F.col("storage_id").alias("entity_id"), F.lit("success").alias("status"))
    return library.ingest_results(downloads, downloads.join(same, "entity_id"), parsed, done)


@register(f"{_LIB} SELECT min(entity_id) AS entity_id FROM dl WHERE status <> 'failed' GROUP BY sha256")
def lib_parseable(spark, d):
    """One paper to parse for each content."""
    return library.parseable(_sides(spark, d)[0])


@register(f"{_LIB}, sv AS (SELECT entity_id, string_agg(DISTINCT 'c' || (k % 3), ';' ORDER BY 'c' || (k % 3)) AS collections FROM w WHERE k % 4 = 1 GROUP BY 1) SELECT coalesce(sel.entity_id, sv.entity_id) AS entity_id, index_status, coalesce(collections, '') AS collections FROM sel FULL JOIN sv ON sv.entity_id = sel.entity_id")
def lib_view(spark, d):
    """Local and saved papers with their collections."""
    saved = _papers(spark, d).where("k % 4 = 1").select("entity_id", F.concat(F.lit("c"), F.col("k") % 3).alias("collection_id"))
    return library.library_view(library.selected_artifacts(_items(spark, d)), saved).select("entity_id", "index_status", F.array_join("collections", ";").alias("collections"))


@register(f"{_LIB}, g AS (SELECT entity_id FROM w WHERE k % 9 = 0) SELECT what, dl_n AS downloads, ps_n AS parsed, ix_n AS indexed, vs_n AS vectors FROM (SELECT 'pdf' AS what, (SELECT count(*) FROM dl WHERE entity_id NOT IN (SELECT * FROM g)) AS dl_n, (SELECT count(*) FROM ps) AS ps_n, (SELECT count(*) FROM ps) AS ix_n, (SELECT count(*) FROM vs) AS vs_n UNION ALL SELECT 'parse', (SELECT count(*) FROM dl), (SELECT count(*) FROM ps WHERE entity_id NOT IN (SELECT * FROM g)), (SELECT count(*) FROM ps WHERE entity_id NOT IN (SELECT * FROM g)), (SELECT count(*) FROM vs WHERE entity_id NOT IN (SELECT * FROM g)) UNION ALL SELECT 'ingest', (SELECT count(*) FROM dl), (SELECT count(*) FROM ps), (SELECT count(*) FROM ps WHERE entity_id NOT IN (SELECT * FROM g)), (SELECT count(*) FROM vs WHERE entity_id NOT IN (SELECT * FROM g)) UNION ALL SELECT 'all', (SELECT count(*) FROM dl WHERE entity_id NOT IN (SELECT * FROM g)), (SELECT count(*) FROM ps WHERE entity_id NOT IN (SELECT * FROM g)), (SELECT count(*) FROM ps WHERE entity_id NOT IN (SELECT * FROM g)), (SELECT count(*) FROM vs WHERE entity_id NOT IN (SELECT * FROM g)))")
def lib_cleanup(spark, d):
    """What is left of each table after each kind of cleanup."""
    downloads, parsed, stored, _ = _sides(spark, d)
    ids = _papers(spark, d).where("k % 9 = 0")
    out = None
    for what in ("pdf", "parse", "ingest", "all"):
        a, b, c = library.cleaned(downloads, parsed, stored, ids, what)
        row = a.agg(F.count("*").alias("downloads")).join(b.agg(F.count("*").alias("parsed"), F.count("indexed_hash").alias("indexed"))).join(c.agg(F.count("*").alias("vectors"))).select(F.lit(what).alias("what"), "downloads", "parsed", "indexed", "vectors")
        out = row if out is None else out.unionAll(row)
    return out


@register(f"WITH {RECORDS}, v AS (SELECT venue, year, paper_id, min(list_status) AS status FROM r WHERE source_tier = 'official' GROUP BY 1, 2, 3) SELECT r.record_id, coalesce(v.status, 'unreviewed') AS status FROM r LEFT JOIN v ON v.venue = r.venue AND v.year = r.year AND v.paper_id = r.paper_id")
def state_publication_review(spark, d):
    r = records(spark, d, "venue", "year", "paper_id", "source_tier", "list_status")
    reviews = r.where("source_tier = 'official'").select("venue", "year", "paper_id", F.lit(None).cast("string").alias("other_paper_id"), F.col("list_status").alias("status"))
    return library.publication_review(r, reviews)


@register("SELECT release_id AS report_id, source_digest IS DISTINCT FROM (SELECT arg_max(source_digest, created_at) FROM data_releases WHERE status = 'ready') AS stale FROM data_releases")
def state_report_staleness(spark, d):
    """Whether the report of each release is older than the content of the active one."""
    r = table(spark, d, "data_releases")
    active = r.where("status = 'ready'").agg(F.max_by("source_digest", "created_at").alias("source_digest"))
    return library.stale(r.select(F.col("release_id").alias("report_id"), "source_digest"), active)


@register("WITH e AS (SELECT DISTINCT entity_id FROM paper_entities), l AS (SELECT DISTINCT entity_id FROM entity_area_assignments), w AS (SELECT DISTINCT entity_id FROM documents WHERE entity_id IS NOT NULL) SELECT entity_id FROM w WHERE entity_id IN (SELECT entity_id FROM e) AND entity_id IN (SELECT entity_id FROM l WHERE entity_id IS NOT NULL)")
def state_scope(spark, d):
    """Papers with documents that are current and labelled."""
    w = table(spark, d, "documents").where("entity_id IS NOT NULL")
    return state.scope(w, table(spark, d, "paper_entities"), table(spark, d, "entity_area_assignments"))


@register("SELECT entity_id FROM (SELECT DISTINCT entity_id FROM entity_area_assignments WHERE area_id <> 'other') INTERSECT SELECT entity_id FROM documents")
def state_shared_ids(spark, d):
    return state.shared_keys(table(spark, d, "entity_area_assignments").where("area_id <> 'other'"), table(spark, d, "documents"), "entity_id")


@register("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def state_first_seen(spark, d):
    return state.first_seen(table(spark, d, "events"), "event_type", "event_id")


_DRAFT = f"""{_LIB}, co(collection_id, rule) AS (VALUES ('c0', 'about retrieval'), ('c1', ''), ('c2', 'about video')), mb AS (SELECT entity_id, 'c' || (k % 3) AS collection_id FROM w WHERE k % 4 = 1), de AS (SELECT entity_id, 'c' || (k % 2 * 2) AS collection_id, CASE WHEN k % 7 = 3 THEN 'another rule' WHEN k % 2 = 0 THEN 'about retrieval' ELSE 'about video' END AS rule, CASE k % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE 'maybe' END AS decision, (k % 13) / 10.0 AS confidence, CASE WHEN k % 8 = 6 THEN ' ' ELSE 'said so' END AS reason FROM w), ev AS (SELECT entity_id FROM w WHERE k % 5 <> 4),
j AS (SELECT sel.entity_id, co.collection_id, sel.index_status = 'indexed_current' AND trim(co.rule) <> '' AND de.rule = co.rule AND ev.entity_id IS NOT NULL AND trim(coalesce(de.reason, '')) <> '' AND de.decision IN ('include', 'exclude', 'review') AS ok, de.decision, de.confidence, mb.entity_id IS NOT NULL AS already_present FROM sel CROSS JOIN co LEFT JOIN de ON de.entity_id = sel.entity_id AND de.collection_id = co.collection_id LEFT JOIN mb ON mb.entity_id = sel.entity_id AND mb.collection_id = co.collection_id LEFT JOIN ev ON ev.entity_id = sel.entity_id),
su AS (SELECT entity_id, collection_id, CASE WHEN coalesce(ok, false) THEN decision ELSE 'review' END AS decision, CASE WHEN coalesce(ok, false) THEN greatest(0.0, least(1.0, CAST(confidence AS DOUBLE))) ELSE 0.0 END AS confidence, already_present FROM j)"""


def _draft(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = _papers(spark, d)
    c = spark.createDataFrame([("c0", "about retrieval"), ("c1", ""), ("c2", "about video")], "collection_id string, rule string")
    m = w.where("k % 4 = 1").select("entity_id", F.concat(F.lit("c"), F.col("k") % 3).alias("collection_id"))
    said = w.select("entity_id", F.concat(F.lit("c"), F.col("k") % 2 * 2).alias("collection_id"), F.when(F.col("k") % 7 == 3, "another rule").when(F.col("k") % 2 == 0, "about retrieval").otherwise("about video").alias("rule"), F.when(F.col("k") % 3 == 0, "include").when(F.col("k") % 3 == 1, "exclude").otherwise("maybe").alias("decision"), (F.col("k") % 13 / 10.0).alias("confidence"), F.when(F.col("k") % 8 == 6, " ").otherwise("said so").alias("reason"))
    papers = library.selected_artifacts(_items(spark, d)).select("entity_id", "index_status", F.col("updated_at").alias("parsed_hash"))
    return papers, m, state.drafted(papers, c, m, said, w.where("k % 5 <> 4"))


@register(f"{_DRAFT} SELECT * FROM su")
def state_draft(spark, d):
    """A suggestion for each paper and collection."""
    return _draft(spark, d)[2].drop("reason", "parsed_hash")


@register(f"{_DRAFT} SELECT entity_id, collection_id FROM mb UNION SELECT entity_id, collection_id FROM su WHERE decision = 'include'")
def state_draft_applied(spark, d):
    """The members after the draft is applied, and applied again."""
    papers, m, draft = _draft(spark, d)
    once, _ = state.applied(draft, m, papers)
    return state.applied(draft, spool(once, "members"), papers)[0]


_CHAT = "WITH t AS (SELECT user_id AS conversation_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS role, CAST(event_id AS VARCHAR) AS text FROM events)"


def _turns(spark, d) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("conversation_id"), n.alias("turn"), F.col("event_type").alias("role"), F.col("event_id").cast("string").alias("text"))


@register(f"{_CHAT}, g AS (SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, to_json(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn)) AS messages_json, count(*) AS message_count FROM t GROUP BY 1) SELECT 'snap_' || substr(sha256(conversation_id || chr(0) || '2024-01-01' || messages_json), 1, 12) AS snapshot_id, conversation_id, 'kept' AS label, messages_json, message_count, '2024-01-01' AS created_at FROM g")
def state_snapshots(spark, d):
    """A snapshot of each conversation."""
    return state.snapshots(_turns(spark, d), "kept", "2024-01-01")


@register(f"{_CHAT} SELECT CAST(conversation_id AS VARCHAR) AS conversation_id, turn, text FROM t WHERE conversation_id % 2 = 1 OR turn <= 5")
def state_truncated(spark, d):
    """Conversations of even number cut after five turns, taken back from snapshots."""
    t = state.restored_messages(state.snapshots(_turns(spark, d), "kept", "2024-01-01"))
    cut = t.where("CAST(conversation_id AS BIGINT) % 2 = 0").select("conversation_id").distinct().withColumn("after", F.lit(5))
    return state.truncated_after(t, cut).select("conversation_id", "turn", "text")


@register("SELECT table_name, count(*) AS n FROM (SELECT 'events' AS table_name FROM events UNION ALL SELECT 'releases' FROM data_releases) GROUP BY 1")
def state_backup(spark, d):
    """Two tables backed up and restored into what is left of them."""
    now = {"events": table(spark, d, "events").select("event_id", "user_id", "event_type"), "releases": table(spark, d, "data_releases").select("release_id", "status")}
    saved = spool(state.backup(now), "backup")
    left = {"events": now["events"].where("event_id % 3 = 0"), "releases": now["releases"].where("false")}
    back = state.restored(left, saved, {"events": ["event_id"], "releases": ["release_id"]})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in back.items()]
    return parts[0].unionAll(parts[1])


_PAIRS = "p AS (SELECT entity_id, min(area_id) AS gold, coalesce(min(nullif(area_secondary, '')), min(area_id)) AS pred FROM entity_area_assignments WHERE entity_id IS NOT NULL GROUP BY 1 HAVING max(is_non_paper) = 0)"


def _label_pairs(spark, d) -> DataFrame:
    return labels(spark, d).where("is_non_paper = 0").select("entity_id", F.col("area_id").alias("gold"), F.coalesce("direction_id", "area_id").alias("pred"))


@register(f"WITH {_PAIRS}, c AS (SELECT label, coalesce(g, 0) AS g, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM (SELECT gold AS label, count(*) AS g, count(*) FILTER (WHERE gold = pred) AS h FROM p GROUP BY 1) FULL JOIN (SELECT pred AS label, count(*) AS q FROM p GROUP BY 1) USING (label)) SELECT round(avg(CASE WHEN q > 0 THEN h / CAST(q AS DOUBLE) ELSE 0 END) FILTER (WHERE g >= 2), 4) AS macro_precision, round(avg(CASE WHEN g > 0 THEN h / CAST(g AS DOUBLE) ELSE 0 END) FILTER (WHERE g >= 2), 4) AS macro_recall, round(avg(2.0 * h / (g + q)) FILTER (WHERE g >= 2), 4) AS macro_f1, round(sum(h) / CAST(sum(q) AS DOUBLE), 4) AS micro_precision, round(sum(h) / CAST(sum(g) AS DOUBLE), 4) AS micro_recall, count(*) FILTER (WHERE g >= 2) AS n_classes FROM c")
def eval_averages(spark, d):
    """Macro and micro averages over the classes."""
    return evaluation.averages(evaluation.class_metrics(_label_pairs(spark, d), "gold", "pred"))


@register(f"WITH {_PAIRS}, g AS (SELECT gold, pred, count(*) AS n, array_to_string(list(entity_id ORDER BY entity_id)[1:3], ';') AS examples FROM p WHERE gold <> pred GROUP BY 1, 2) SELECT * FROM g ORDER BY n DESC, gold, pred LIMIT 10")
def eval_confusions(spark, d):
    """The ten most frequent confusions with up to three examples."""
    return evaluation.confusions(_label_pairs(spark, d), "gold", "pred", "entity_id").withColumn("examples", F.array_join("examples", ";"))


@register(f"WITH {_PAIRS} SELECT count(*) AS n, count(*) FILTER (WHERE gold = pred) AS strict_agree, count(*) FILTER (WHERE gold = pred OR pred = 'other') AS soft_agree, round(count(*) FILTER (WHERE gold = pred OR pred = 'other') / CAST(count(*) AS DOUBLE), 4) AS soft_rate FROM p")
def eval_soft_agreement(spark, d):
    return evaluation.soft_agreement(_label_pairs(spark, d), "gold", "pred", F.col("pred") == "other")


_SAMPLES = f"WITH {BASE}, s AS (SELECT entity_id AS sample_id, area_id AS topic_id, length(title) % 9 AS score, CASE WHEN length(title) % 9 >= 6 THEN 'high' WHEN length(title) % 9 > 3 THEN 'middle' ELSE 'boundary' END AS band, CASE length(title) % 5 WHEN 0 THEN 'relevant' WHEN 1 THEN 'relevant' WHEN 2 THEN 'mention_only' WHEN 3 THEN 'wrong_signal' ELSE 'pending' END AS verdict, CASE WHEN length(title) % 5 = 3 THEN 'homonym' WHEN length(title) % 5 = 2 THEN 'passing' ELSE '' END AS error_type FROM b)"


def _samples(spark, d) -> DataFrame:
    n = F.length("title")
    s = base(spark, d, "title").select(F.col("entity_id").alias("sample_id"), F.col("area_id").alias("topic_id"), (n % 9).alias("score"))
    reviews = base(spark, d, "title").where(n % 5 != 4).select(F.col("entity_id").alias("sample_id"), F.when(n % 5 < 2, "relevant").when(n % 5 == 2, "mention_only").otherwise("wrong_signal").alias("verdict"), F.when(n % 5 == 3, "homonym").when(n % 5 == 2, "passing").otherwise("").alias("error_type"))
    return evaluation.reviewed_samples(s, reviews, table(spark, d, "area_definitions").select(F.col("area_id").alias("topic_id")).distinct()).withColumn("band", evaluation.score_band(F.col("score")))


@register(f"{_SAMPLES} SELECT sample_id, topic_id, score, band, verdict, error_type FROM s WHERE topic_id IN (SELECT area_id FROM area_definitions)")
def eval_samples(spark, d):
    """Samples with their reviews laid over them."""
    return _samples(spark, d)


@register(f"{_SAMPLES}, x AS (SELECT topic_id, band, verdict FROM s WHERE topic_id IN (SELECT area_id FROM area_definitions)), g AS (SELECT topic_id, band, count(*) FILTER (WHERE verdict = 'relevant') AS relevant, count(*) FILTER (WHERE verdict = 'mention_only') AS mention_only, count(*) FILTER (WHERE verdict = 'wrong_signal') AS wrong_signal, 0 AS uncertain, count(*) FILTER (WHERE verdict IN ('relevant', 'mention_only', 'wrong_signal')) AS k FROM x GROUP BY GROUPING SETS ((topic_id, band), (topic_id), (band), ())) SELECT topic_id, band, relevant, mention_only, wrong_signal, uncertain, CASE WHEN k > 0 THEN round_even(100.0 * relevant / k, 1) END AS precision, CASE WHEN k > 0 THEN round_even(least(greatest(100 * (relevant / k + 1.96 * 1.96 / (2 * k) - 1.96 * sqrt(relevant / k * (1 - relevant / k) / k + 1.96 * 1.96 / (4.0 * k * k))) / (1 + 1.96 * 1.96 / k), 0), 100), 1) END AS low, CASE WHEN k > 0 THEN round_even(least(greatest(100 * (relevant / k + 1.96 * 1.96 / (2 * k) + 1.96 * sqrt(relevant / k * (1 - relevant / k) / k + 1.96 * 1.96 / (4.0 * k * k))) / (1 + 1.96 * 1.96 / k), 0), 100), 1) END AS high FROM g")
def eval_precision(spark, d):
    """Precision with its interval by topic and band, by each, and overall."""
    return evaluation.precision_table(_samples(spark, d))


@register(f"{_SAMPLES} SELECT error_type, count(*) AS n FROM s WHERE error_type <> '' GROUP BY 1")
def eval_error_groups(spark, d):
    return evaluation.error_groups(_samples(spark, d))


@register(f"{_SAMPLES} SELECT sample_id, topic_id, band, verdict, score FROM s WHERE topic_id IN (SELECT area_id FROM area_definitions) ORDER BY CASE verdict WHEN 'wrong_signal' THEN 0 WHEN 'mention_only' THEN 1 WHEN 'uncertain' THEN 2 WHEN 'relevant' THEN 3 ELSE 4 END, topic_id, band, score DESC, sample_id LIMIT 25")
def eval_sample_page(spark, d):
    """The first page of the samples, those with errors first."""
    return evaluation.sample_page(_samples(spark, d), 1, 25)


_GOLD = f"WITH {BASE}, sa AS (SELECT entity_id, row_number() OVER (PARTITION BY area_id ORDER BY sha256('gold' || chr(0) || entity_id)) AS sample_order, area_id, coalesce(direction_id, '') AS direction_id FROM b), x AS (SELECT * FROM sa WHERE sample_order <= 20), rv AS (SELECT entity_id, CASE WHEN sample_order % 3 = 0 AND direction_id <> '' THEN direction_id ELSE area_id END AS gold_area, CASE WHEN sample_order % 3 = 0 AND direction_id <> '' THEN area_id ELSE direction_id END AS gold_direction FROM x)"


@register(f"{_GOLD} SELECT x.entity_id, sample_order, area_id AS system_area, gold_area, gold_direction, CASE WHEN gold_area = area_id AND gold_direction = direction_id THEN 'agree_system' WHEN gold_area = direction_id AND gold_direction = area_id THEN 'agree_prelabel' ELSE 'changed' END AS verdict FROM x JOIN rv USING (entity_id) ORDER BY sample_order, x.entity_id")
def eval_gold(spark, d):
    """A gold sample merged from reviews."""
    b = base(spark, d).select("entity_id", "area_id", F.coalesce("direction_id", F.lit("")).alias("direction_id"))
    sample = spool(evaluation.sampled(b, ["area_id"], "entity_id", 20, "gold"), "gold-sample")
    turned = (F.col("sample_order") % 3 == 0) & (F.col("direction_id") != "")
    reviews = sample.select("entity_id", F.when(turned, F.col("direction_id")).otherwise(F.col("area_id")).alias("area"), F.when(turned, F.col("area_id")).otherwise(F.col("direction_id")).alias("direction"))
    guesses = sample.select("entity_id", F.col("direction_id").alias("pred_area"), F.col("area_id").alias("pred_direction"))
    return evaluation.gold_merged(sample, guesses, reviews).select("entity_id", "sample_order", "system_area", "gold_area", "gold_direction", "verdict")


@register("SELECT arg_max(labels_version, labels_version) AS labels_version, count(DISTINCT entity_id) AS n_entities, count(DISTINCT area_id) AS n_areas FROM entity_area_assignments WHERE labels_version = (SELECT max(labels_version) FROM entity_area_assignments)")
def label_release(spark, d):
    """The newest version of the labels and its size."""
    a = table(spark, d, "entity_area_assignments")
    newest = a.agg(F.max("labels_version").alias("labels_version"))
    return a.join(newest, "labels_version").groupBy("labels_version").agg(F.countDistinct("entity_id").alias("n_entities"), F.countDistinct("area_id").alias("n_areas"))


@register(f"WITH {RECORDS} SELECT count(*) AS n, sum(length(title)) AS title_chars, sum(length(abstract)) AS abstract_chars, round(sum(length(coalesce(title, '')) + length(coalesce(abstract, ''))) / 4.0 / 1000000 * 0.5, 6) AS cost FROM r")
def translation_cost(spark, d):
    """The cost of a translation by characters."""
    return evaluation.translation_cost(records(spark, d, "title", "abstract"), 4.0, 0.5)


@register("WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings), u AS (SELECT id, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM v), q AS (SELECT label, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM u), m AS (SELECT label, i, avg(x) AS x FROM q GROUP BY 1, 2), c AS (SELECT label AS center, list(x ORDER BY i) AS c FROM m GROUP BY label), p AS (SELECT id, label, center, list_cosine_similarity(u.x, c.c) AS s FROM u, c), o AS (SELECT id, label, s, id % 7 AS task FROM p WHERE center = label), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY label, task ORDER BY round(s, 9) DESC, id) = 1), rp AS (SELECT label, id, 'representative' AS kind, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, id) AS place FROM f), mg AS (SELECT a.id, a.label, a.s - max(b.s) AS margin FROM p a JOIN p b ON a.id = b.id AND b.center <> a.center WHERE a.center = a.label GROUP BY a.id, a.label, a.s), bd AS (SELECT label, id, 'boundary' AS kind, row_number() OVER (PARTITION BY label ORDER BY round(margin, 9), id) AS place FROM mg) SELECT * FROM rp WHERE place <= 4 UNION ALL SELECT * FROM bd WHERE place <= 3")
def vector_representatives(spark, d):
    """Of each label four representatives of different tasks and the three vectors nearest to another label."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 7).alias("task"))
    return vectors.representatives(v, "label", "task", 4, 3)


@register("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def vector_counts(spark, d):
    """Vectors by document; labels stand for documents."""
    return vectors.document_counts(table(spark, d, "embeddings"), "label")


_TEXT = "(SELECT entity_id, string_agg({0}, chr(10) ORDER BY o) AS {0} FROM (SELECT m.entity_id, r.{0}, min((1 - coalesce(m.is_canonical, 0), r.record_id)) AS o FROM m JOIN r ON r.record_id = m.record_id WHERE r.{0} <> '' GROUP BY 1, 2) GROUP BY 1)"


@register(f"WITH {RECORDS}, m AS (SELECT DISTINCT record_id, entity_id, is_canonical FROM entity_memberships) SELECT e.entity_id, coalesce(t.title, '') AS title, coalesce(a.abstract, '') AS abstract FROM (SELECT DISTINCT m.entity_id FROM m JOIN r ON r.record_id = m.record_id) e LEFT JOIN {_TEXT.format('title')} t ON t.entity_id = e.entity_id LEFT JOIN {_TEXT.format('abstract')} a ON a.entity_id = e.entity_id")
def topic_entity_texts(spark, d):
    """The distinct titles and abstracts of each entity, those of its canonical record first."""
    return topics.entity_texts(members(spark, d, "is_canonical"), records(spark, d, "title", "abstract"))


@register(f"{_LIB}, c(collection_id) AS (VALUES ('c0'), ('c1'), ('c2'), ('c9')), mb AS (SELECT DISTINCT coalesce(al.current, w.entity_id) AS entity_id, 'c' || (k % 3) AS collection_id FROM w LEFT JOIN al ON al.old = w.entity_id WHERE k % 4 = 1) SELECT c.collection_id, count(mb.entity_id) AS n FROM c LEFT JOIN mb USING (collection_id) GROUP BY 1")
def state_collection_counts(spark, d):
    """Members of each collection under their current ids, empty collections included."""
    saved = _papers(spark, d).where("k % 4 = 1").select("entity_id", F.concat(F.lit("c"), F.col("k") % 3).alias("collection_id"))
    c = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("c9",)], "collection_id string")
    return state.collection_counts(c, state.current_members(saved, _sides(spark, d)[3]))


@register("WITH w AS (SELECT entity_id, min(doc_id) AS k FROM documents WHERE entity_id IS NOT NULL GROUP BY 1) SELECT entity_id FROM w WHERE NOT (k % 7 = 0 AND k % 14 <> 0)")
def state_visible(spark, d):
    """Papers that were not deleted, or restored after it."""
    w = _papers(spark, d)
    gone = w.where("k % 7 = 0").select("entity_id", F.when(F.col("k") % 14 == 0, "2024-01-02").alias("restored_at"))
    return state.visible(w.select("entity_id"), gone, "entity_id")


@register("WITH w AS (SELECT entity_id, min(doc_id) AS k FROM documents WHERE entity_id IS NOT NULL GROUP BY 1), a AS (SELECT * FROM w WHERE k % 2 = 0) SELECT entity_id, CASE WHEN k % 3 > 0 THEN 'method' END AS field, CASE WHEN k % 3 > 0 THEN CAST(k AS VARCHAR) END AS value, k % 3 > 0 AS shown FROM a")
def state_comparison(spark, d):
    """Cells of a comparison that have evidence; papers without stay."""
    w = _papers(spark, d)
    cells = w.select("entity_id", F.lit("method").alias("field"), F.col("k").cast("string").alias("value"), F.slice(F.array(F.lit("p1"), F.lit("p2")), 1, (F.col("k") % 3).cast("int")).alias("evidence"))
    return state.comparison(w.where("k % 2 = 0").select("entity_id"), cells)


@register("SELECT user_id, event_id FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT user_id, event_id FROM events WHERE user_id % 3 = 0 AND event_id % 2 = 0 UNION ALL SELECT user_id, event_id FROM events WHERE user_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0)")
def state_replaced(spark, d):
    """Events in which those of some users are replaced as a whole."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return state.replaced(e, e.where("user_id % 3 = 0 AND event_id % 2 = 0"), "user_id")


@register(f"WITH {RECORDS}, {ENTITIES}, w AS (SELECT entity_id, min(doc_id) AS k FROM documents WHERE entity_id IS NOT NULL GROUP BY 1), p AS (SELECT e.entity_id, CASE WHEN NOT {sql_missing('pdf_url')} THEN 'catalog' WHEN NOT {sql_missing('arxiv_id')} THEN 'arxiv' ELSE 'none' END AS source FROM e JOIN r ON r.record_id = e.canonical_record_id), st AS (SELECT entity_id, CASE k % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'failed' ELSE 'queued' END AS was FROM w) SELECT p.entity_id, CASE WHEN was IN ('success', 'duplicate') THEN 'present' WHEN source = 'none' THEN 'unavailable' WHEN was = 'failed' THEN 'retry' ELSE 'planned' END AS plan_status FROM p LEFT JOIN st USING (entity_id)")
def state_plan_status(spark, d):
    """The download plan with what became of earlier downloads."""
    p = entities(spark, d, "canonical_record_id").join(records(spark, d, "pdf_url", "arxiv_id"), F.col("canonical_record_id") == F.col("record_id"))
    k = F.col("k") % 4
    was = _papers(spark, d).select("entity_id", F.when(k == 0, "success").when(k == 1, "duplicate").when(k == 2, "failed").otherwise("queued").alias("status"))
    return state.download_plan(p, was).select("entity_id", "plan_status")


@register(f"WITH {RECORDS}, f AS (SELECT arg_min(release_id, created_at) AS first FROM data_releases WHERE status = 'ready'), x AS (SELECT venue, year, title, min(abstract) FILTER (WHERE release_id = (SELECT first FROM f)) AS a, min(abstract) AS b FROM r WHERE NOT {sql_missing('abstract')} GROUP BY 1, 2, 3) SELECT r.record_id, CASE WHEN NOT {sql_missing('r.abstract')} THEN 'own' WHEN x.a IS NOT NULL THEN 'first_release' WHEN x.b IS NOT NULL THEN 'any_release' END AS layer FROM r LEFT JOIN x ON x.venue = r.venue AND x.year = r.year AND x.title = r.title")
def match_layers(spark, d):
    """Where each record's abstract is taken from: itself, the first release, or any, by venue, year and title."""
    r = records(spark, d, "venue", "year", "title", "abstract", "release_id")
    first = table(spark, d, "data_releases").where("status = 'ready'").agg(F.min_by("release_id", "created_at").alias("release_id"))
    return matching.layered(r, [("first_release", r.join(first, "release_id", "left_semi")), ("any_release", r)], ["venue", "year", "title"], "abstract").select("record_id", "layer")
