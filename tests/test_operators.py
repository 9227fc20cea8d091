import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.functions import columns as C
from quirelake.functions import text as X
from quirelake.functions import values as V
from quirelake import protocols, service, tasks
from quirelake.operators import evaluation, labelling, state, topics, vectors
from quirelake.sources import readers, writers
from quirelake.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


NON_PAPERS = {
    "Editorial Board": "front_matter", "Table of Contents": "front_matter", "Transactions on Things publication information": "", "IEEE Transactions on Image Processing publication information": "front_matter", "Preface.": "front_matter",
    "VIS 2024 Program Committee": "committee_or_reviewers", "IEEE ISMAR 2023 Science &amp; Technology Program Committee Members for Journal Papers": "committee_or_reviewers", "2025 Reviewers List <sup>*</sup>": "committee_or_reviewers",
    "2024 VGTC Visualization Service Award": "award_or_statement", "Models for Search: Introduction to the Special Issue—Part 2": "editorial", "Message from the Editor-in-Chief": "editorial", "Erratum: Wavelet Fluids": "correction_notice", "Notice of Retraction: CHN": "retraction",
    "Preface: A Volumetric Prior": "", "Reconfiguring Proportional Committees": "", "Approval-based committee voting": "", "Optimization without Retraction": "", "Welcome to the Dark Side": "", "Low-rank correction to the Laplace method": "", "Metaphors in News Editorials": "", "A Dataset for the Reviewer Assignment Problem": "",
}


def test_record_kinds(spark):
    got = spark.createDataFrame([(t,) for t in NON_PAPERS], "t string").select("t", C.record_kind(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == NON_PAPERS


def test_values(spark):
    assert V.service_query('training-free "super resolution" of the image') == 'all:"training free" AND all:"super resolution" AND all:image'
    assert V.service_query("the") == 'all:"the"' and V.service_query('a "b') == "all:b"
    assert V.short_title("What is the best way to rank papers by relevance?") == "What is the best way to rank…" and V.short_title("short") == "short"
    long = {"items": [{"text": "x" * 900} for _ in range(40)]}
    assert V.trimmed({"a": 1}) == {"a": 1}
    assert V.trimmed(long, 10_000)["items"][0]["text"] == "x" * 200 + "…" and len(V.trimmed(long, 10_000)["items"]) == 40
    assert V.trimmed(long, 5_000)["items_omitted"] == 20 and V.trimmed(long, 100)["truncated"]
    assert one(spark, V.point_id(F.lit("d:1"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "d:1"))
    j = one(spark, V.rewritten_json(F.lit('{"entity_id": "a", "x": [{"entity_ids": ["a", "b"]}]}'), F.lit('{"a": "b"}')))
    assert json.loads(j) == {"entity_id": "b", "x": [{"entity_ids": ["b"]}]}


def test_columns(spark):
    assert one(spark, C.arxiv_key(F.lit(" arXiv:2401.00001v3 "))) == "2401.00001"
    assert one(spark, C.forum_key(F.lit("https://a.org"), F.lit("https://openreview.net/forum?id=Ab_1&x=2"))) == "Ab_1"
    assert one(spark, C.url_access(F.lit("https://arxiv.org/abs/1"))) == "open"
    assert one(spark, C.url_access(F.lit(""))) == "none"
    assert one(spark, C.shown_authors(F.lit("A; B and C; D"))) == "A; B; C 等"
    assert one(spark, C.inverted_text(F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(2)), F.lit("a"), F.array(F.lit(0))))) == "a b b"
    assert one(spark, C.record_kind(F.lit("Guest Editorial on X"))) == "editorial"
    assert one(spark, C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_text():
    assert X.title_key("Ｆｕｌｌ-width ß_x") == "fullwidthss_x"
    assert X.plain_title_key("A &amp; <i>B</i>") == "ab"
    assert X.phrase_text("State-of-the <b>Art</b>!") == "state of the art"
    assert X.strip_affiliations("A (x (y)), B") == ("A, B", True)
    assert X.strip_affiliations("A (x")[1] is False
    assert X.clean_markup("<p>a</p><p>b<i>c</i></p>") == "a bc"


def test_topics(spark):
    conf = topics.load_topics([{"topic_id": "a", "family": "f", "strong": ["graph networks"], "weak": ["edges"], "threshold": 3}, {"topic_id": "b", "family": "g", "strong": ["image"], "anchors": ["vision"], "threshold": 3, "concrete": True}, {"topic_id": "c", "family": "h", "benchmarks": ["imagenet"], "threshold": 3}])
    rows = [("1", "graph networks", "edges here"), ("2", "image", "for vision and graph networks"), ("3", "image", "no anchor"), ("4", "imagenet", None), ("5", None, None), ("6", "visions of image imagenet", "graph networks")]
    got = {(r["entity_id"], r["topic_id"], r["score"], r["role"]) for r in topics.classify(spark.createDataFrame(rows, "entity_id string, title string, abstract string"), conf).collect()}
    assert ("1", "a", 7.0, "primary") in got and ("4", "c", 6.0, "primary") in got
    assert ("2", "b", 6.0, "primary") in got and not any(r[0] in ("3", "5") for r in got)
    assert {r[1] for r in got if r[0] == "6"} == {"b"}
    with pytest.raises(ValueError, match="repeats"):
        topics.load_topics([{"topic_id": "a", "family": "f", "strong": ["x"]}] * 2)
    tags = topics.scan_tags(spark.createDataFrame(rows, "entity_id string, title string, abstract string"), [topics.Tag("t", ("edges", "graph networks"))])
    assert {(r["entity_id"], r["term"], r["field"]) for r in tags.collect()} >= {("1", "edges", "abstract"), ("2", "graph networks", "abstract")}


def test_ancestors(spark):
    p = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "topic_id string, parent_topic_id string")
    assert {tuple(r) for r in topics.ancestors(spark, p).collect()} == {("a", "a", 0), ("b", "b", 0), ("c", "c", 0), ("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


def test_split_markdown():
    text = "before\n\n# One\n\n" + "\n\n".join(["p" * 50] * 4) + "\n\n## Empty\n# Last\nend"
    got = vectors.split_markdown(text, 120)
    assert got[0] == ("", "before") and got[-1] == ("# Last", "# Last\n\nend") and ("## Empty", "## Empty") in got
    assert all(p.startswith("# One\n\n") for s, p in got if s == "# One") and all(len(p) <= 120 for _, p in got)
    assert sum(p.count("p" * 50) for _, p in got) == 4
    assert vectors.split_markdown("# 标题\n\n正文内容\n\n## 第二节\n\n更多内容") == [("# 标题", "# 标题\n\n正文内容"), ("## 第二节", "## 第二节\n\n更多内容")]
    assert vectors.split_markdown("# A\n" + "x" * 300, 100) == [("# A", "# A"), ("# A", "# A\n\n" + "x" * 300)]
    assert vectors.split_markdown(None) == [] and vectors.split_markdown("  ") == [] and vectors.split_markdown("plain") == [("", "plain")]
    assert vectors.split_markdown("x" * 5000) == [("", "x" * 5000)]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [(200, [0.0] * 8), (201, None)]
    df = spark.createDataFrame(v, "id bigint, embedding array<double>")
    got = {(r["query_id"], r["place"]): r["id"] for r in vectors.nearest(df.where("id % 20 = 0"), df, 3, block_rows=30).collect()}
    m = np.array([x for i, x in v[:120]])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 120, 20):
        want = sorted(range(120), key=lambda i: (-round(float(m[q] @ m[i]), 9), i))[:3]
        assert [got[q, p] for p in (1, 2, 3)] == want


def test_index_states(spark):
    p = spark.createDataFrame([("a", True, True, "h", "h", "f", 2), ("b", False, None, None, None, None, None), ("c", True, False, "h", None, None, None), ("d", True, True, "h", "old", "f", 2), ("e", True, True, "h", None, None, None)], "entity_id string, parsed boolean, file_exists boolean, parsed_hash string, indexed_hash string, indexed_fingerprint string, indexed_chunks bigint")
    v = spark.createDataFrame([("a", 2), ("d", 2), ("z", 1)], "entity_id string, chunks bigint")
    got = {r["entity_id"]: r["state"] for r in vectors.index_states(p, v, "f").collect()}
    assert got == {"a": "indexed_current", "b": "pdf_only", "c": "parsed_only", "d": "index_stale", "e": "index_missing", "z": "registry_missing"}


def test_evaluation(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", None)], "g string, p string")
    assert evaluation.overall_metrics(df, "g", "p").first()["correct"] == 3
    assert evaluation.rand_index(df.where("p IS NOT NULL"), "g", "g").first()["ari"] == 1.0
    assert evaluation.kappa(df, "g", "p").first()["n"] == 4
    assert evaluation.allocate({"a": 10, "b": 5, "c": 1}, 8) == {"a": 5, "b": 2, "c": 1}
    # 3.5, 1.75, 1.75: whole parts 3, 1, 1 and minimum 2 make seven
    assert evaluation.allocate({"a": 10, "b": 5, "c": 5}, 7, 2) == {"a": 3, "b": 2, "c": 2}
    assert evaluation.allocate({"a": 90, "b": 5, "c": 5}, 10, 2) == {"a": 6, "b": 2, "c": 2}
    assert evaluation.allocate({"a": 2, "b": 1}, 5) == {"a": 3, "b": 1}
    assert evaluation.overall_metrics(df.where("g = 'x'"), "g", "p").first()["n"] == 0


def test_state(spark):
    snap = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 2), (2, "old", 0), (3, None, 1)], "k int, v string, t int")
    assert {tuple(r) for r in state.upserted(snap, new, ["k"], "t").collect()} == {(1, "c", 2), (2, "b", 1), (3, None, 1)}
    assert state.added_if_absent(snap, new, ["k"]).count() == 3
    assert {tuple(r) for r in state.difference(new, snap, "k").collect()} == {(3, "new")}
    t = spark.createDataFrame([("c", 1, "What is BM25?"), ("c", 2, "and why?"), ("d", 1, "why?")], "conv string, turn int, text string")
    assert {r["standalone"] for r in state.condensed(t, "conv", "turn").collect()} == {"What is BM25?", "What is BM25? and why?", "why?"}
    assert one(spark, state.cited(F.lit("a [2] b [9] c [2] [1]"), F.lit(3))) == [2, 1]


def test_lists(spark, tmp_path):
    root = tmp_path / "conferences"
    root.mkdir()
    head = ",".join(readers.LIST_COLUMNS)
    row = ["p1", "V", "conference", "2024", "", 'A "quoted", title', "A; B"] + [""] * 15
    (root / "v.csv").write_text("﻿" + head + "\n" + ",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n", encoding="utf-8")
    files = readers.list_files(spark, str(tmp_path))
    got = readers.read_lists(spark, files, "rel_1").first()
    assert got["title"] == 'A "quoted", title' and got["year"] == 2024 and len(got["record_id"]) == 64
    (root / "w.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_lists(spark, readers.list_files(spark, str(tmp_path)), "rel_1")
    h = readers.file_hashes(spark, str(tmp_path))
    assert h.count() == 2 and len(readers.digest(h, str(tmp_path))) == 64
    assert readers.changed_files(h.limit(1), h).count() == 1


def test_jsonl_feed_and_pages(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    rows, errors = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2] and [r["value"] for r in errors.collect()] == ["not json"]
    (tmp_path / "feed.xml").write_text("<feed><entry><id>1</id><title>A\n  B</title><summary>s</summary><published>2024</published><author><name>X</name></author><author><name>Y</name></author></entry></feed>")
    feed = readers.read_feed(spark, str(tmp_path / "feed.xml")).first()
    assert feed["authors"] == "X; Y" and feed["total"] is None
    html = '<html><body><div class="paper big"><h4 class="t">A <i>B</i>\n C</h4><p class="who">X, Y<br>Z</p><a href="/1.pdf">pdf</a></div><div class="paper"><h4 class="t">Un&amp;closed<p class="who">Q'
    (tmp_path / "stored").mkdir()
    (tmp_path / "stored" / "p.html").write_text(html)
    got_pages = {r["place"]: r for r in readers.read_pages(spark, str(tmp_path / "stored"), "paper", {"title": "t", "authors": "who"}).collect()}
    assert got_pages[0]["title"] == "A B C" and got_pages[0]["authors"] == "X, YZ" and got_pages[0]["links"] == ["/1.pdf"]
    assert got_pages[1]["title"] == "Un&closed" and got_pages[1]["authors"] == "Q" and got_pages[1]["links"] == []
    assert readers.parse_page(None, "paper", {}) == [] and readers.page_key("s", {"b": "1", "a": "2"}) == readers.page_key("s", {"a": "2", "b": "1"})
    answers = tmp_path / "answers"
    answers.mkdir()
    (answers / "p1.json").write_text(json.dumps({"items": [{"id": "1"}, {"id": "2"}], "next": "p2"}))
    (answers / "p2.json").write_text(json.dumps({"items": [{"id": "3"}], "next": "p3"}))
    saved = readers.read_answers(spark, str(answers), "id string")
    assert sorted(r["id"] for r in saved.collect()) == ["1", "2", "3"] and [r["next"] for r in readers.missing_pages(saved).collect()] == ["p3"]
    pages = tmp_path / "pages"
    pages.mkdir()
    for i in range(3):
        (pages / f"{i}.json").write_text(json.dumps({"items": [{"id": f"{i}-{j}", "title": "t"} for j in range(2)]}))
    spark.dataSource.register(readers.PagedSource)
    assert spark.read.format("quire_paged").option("path", str(pages)).load().count() == 6
    got = readers.looked_up(spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "key string"), lambda ks: {k: k.upper() for k in ks if k != "b"}, 1)
    assert {tuple(r) for r in got.collect()} == {("a", "A")}


def test_service(spark, small):
    call = lambda method, **p: service.handle(spark, small, {"jsonrpc": "2.0", "id": 1, "method": method, "params": p})
    assert call("initialize")["result"]["serverInfo"]["name"] == "quirelake" and call("ping")["result"] == {}
    names = {t["name"] for t in call("tools/list")["result"]["tools"]}
    assert {"count_papers", "recall_topic", "trend"} <= names and len(names) == 11
    got = json.loads(call("tools/call", name="count_papers", arguments={"group_by": "area"})["result"]["content"][0]["text"])
    assert got["ok"] and len(got["data"]) > 3
    assert call("tools/call", name="nope")["result"]["isError"] and call("nope")["error"]["code"] == -32601
    assert service.handle(spark, small, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    recall = service.answer(spark, small, "recall_topic", {"query": "text-to-image generation", "limit": 3})
    assert recall["ok"] and len(recall["data"]["items"]) <= 3 and recall["data"]["method"] in ("phrase", "all_terms")
    assert service.main(["count_papers", "--data", small, "--args", '{"group_by": "year"}'], spark) == 0 and service.main(["nope", "--data", small], spark) == 1


def test_retrieval(spark):
    docs = [protocols.Document("d1", "# One\n\nalpha beta"), protocols.Document("d2", "gamma delta")]
    p = protocols.Pipeline(protocols.MarkdownSplitter(), protocols.HashEmbedder(32))
    rows = p.ingest(spark.createDataFrame([(d.id, d.text) for d in docs], "document_id string, text string"))
    assert rows.count() == 2 and p.ingest(spark.createDataFrame([("d1", "changed")], "document_id string, text string"), rows).where("document_id = 'd1'").count() == 1
    best = p.retrieve(rows, "alpha beta", 1).first()
    assert best["document_id"] == "d1" and p.retrieve(rows, "alpha", 5, {"document_id": ["d2"]}).count() == 1
    back = vectors.reranked(rows.select("id", "embedding"), p.embedder.embed(["alpha beta"])[0], 1, lambda df: df.select("id", F.when(F.col("id") == "d2:0", 1.0).otherwise(0.0).alias("score")))
    assert back.first()["id"] == "d2:0"
    assert p.fingerprint() == p.fingerprint() != protocols.Pipeline(protocols.MarkdownSplitter(10), protocols.HashEmbedder(32)).fingerprint()
    assert vectors.of_document(rows, "document_id", "d1").count() == 1
    children, clashes = vectors.split_children(spark.createDataFrame([(1, "p", "a"), (2, "p", "a"), (3, "p", "b")], "id int, parent string, grp string"), "parent", "grp", spark.createDataFrame([("p", "a", "X"), ("p", "b", "x ")], "parent string, grp string, alias string"))
    assert {r["child"]: r["n"] for r in children.collect()} == {"p_1": 2, "p_2": 1} and [r["alias"] for r in clashes.collect()] == ["x"]
    m = one(spark, vectors.mixed_features(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))))
    assert abs(m[0] - 0.75 / (0.75**2 + 0.25**2) ** 0.5) < 1e-9


def test_runs_and_variants(spark):
    conf = topics.load_topics([{"topic_id": "a", "family": "f", "strong": ["graph networks"], "weak": ["edges"], "threshold": 3}, {"topic_id": "b", "family": "g", "strong": ["image"], "threshold": 3}])
    t = spark.createDataFrame([("1", "graph networks", ""), ("2", "image", ""), ("3", "image of graph networks", "")], "entity_id string, title string, abstract string")
    got = {r["topic_id"]: (r["n_before"], r["n_after"], r["kept"]) for r in topics.simulated(t, conf, {"a": ["graph networks"]}).collect()}
    assert got == {"a": (2, 0, 0), "b": (1, 2, 1)}
    run = topics.run_record("v1", "rel_1", conf)
    assert run == topics.run_record("v1", "rel_1", conf) and run["run_id"] != topics.run_record("v2", "rel_1", conf)["run_id"]
    r = tasks.Runner(spark, 1)
    assert r.run("j", lambda: spark.range(10).count()).result(60) == 10 and r.state("j") == "done"
    bad = r.run("k", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad.result(60)
    assert r.state("k") == "failed" and not r.cancel("k")


def test_label_files(spark):
    rows = spark.createDataFrame([("e1", "nlp", "d1", "high", "a|b", "too many words in this one phrase here"), ("e2", "bad", "d9", "low", "a|b|c|d", "ok"), ("e2", "nlp", "d1", "low", "", "ok"), ("e9", "nlp", "d2", "mid", "a", "ok"), ("e3", "other", "", "high", "", "ok")], "entity_id string, area string, direction_id string, confidence string, tags string, task string")
    dirs = spark.createDataFrame([("d1", "nlp"), ("d2", "cv")], "direction_id string, area_id string")
    ents = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("e4",)], "entity_id string")
    got = {(r["rule"]): r["n"] for r in labelling.import_checks(rows, ents, dirs, ("nlp", "cv", "other"), spark.createDataFrame([("e3",)], "entity_id string")).collect()}
    assert got == {"unknown_entity": 1, "repeated_entity": 1, "unlabelled_entity": 1, "unknown_area": 1, "unknown_direction": 1, "direction_of_another_area": 1, "non_paper_with_direction": 0, "non_paper_not_other": 0, "blank_confidence": 0, "missing_direction": 0}
    e = {(r["entity_id"], r["field"], r["error"]) for r in labelling.phrase_errors(rows, {"task": (1, 6)}, "confidence", "entity_id").collect()}
    assert ("e1", "task", "phrase length") in e and ("e2", "confidence", "low without review") in e


def test_documents_are_whole(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\ntwo\n")
    assert readers.read_documents(spark, str(tmp_path)).first()["text"] == "# One\n\ntwo\n"


def test_release(spark, tmp_path):
    root = str(tmp_path / "cat")
    df = spark.range(5)
    writers.publish(root, "r1", {"t": df}, {"t": lambda t: t.where("id < 0")})
    assert writers.current_release(spark, root)["release_id"] == "r1"
    with pytest.raises(ValueError, match="gate"):
        writers.publish(root, "r2", {"t": df}, {"t": lambda t: t.where("id = 3")})
    assert writers.current_release(spark, root)["release_id"] == "r1"
    writers.write_shards(spark.range(25), str(tmp_path / "shards"), "id", 10)
    back = spark.read.json(str(tmp_path / "shards"))
    assert {(r["shard"], r["n"]) for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {(0, 10), (1, 10), (2, 5)}
    p = spark.createDataFrame([("e", "A & B", "Ann Lee; Bob May", "V", "journal", 2024, "10.1/x", "http://u")], "entity_id string, title string, authors string, venue string, venue_type string, year int, doi string, paper_url string")
    entry = writers.bibtex(p).first()["entry"]
    assert entry.startswith("@article{ABe,\n  title = {A \\& B}") and "  journal = {V}" in entry
    assert writers.bibtex(p.withColumn("venue_type", F.lit("preprint")).withColumn("title", F.lit("∀")).withColumn("entity_id", F.lit("ape_0123456789"))).first()["entry"].startswith("@misc{paper456789,")
    for form in ("csv", "json", "bibtex", "markdown"):
        writers.export(p, str(tmp_path / form), form)


def test_stream(spark, tmp_path):
    cat, src, sink = (str(tmp_path / n) for n in ("cat", "src", "sink"))
    spark.createDataFrame([("r1", "Known Title", "e1", 1)], "record_id string, title string, entity_id string, is_canonical int").write.parquet(cat)
    entries = [("r1", "x", "", ""), ("r2", "known title!", "", ""), ("r3", "Fresh one", "", ""), ("r3", "Fresh one", "", ""), (None, "y", "", "")]
    df = spark.createDataFrame(entries, "record_id string, title string, authors string, arxiv_id string").withColumn("arrived_at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(f"{src}/a")
    spark.read.parquet(f"{src}/a").write.mode("append").parquet(src + "2")
    q = ingest.start(spark, src + "2", cat, sink, str(tmp_path / "cp"))
    q.awaitTermination()
    spark.createDataFrame([("r4", "fresh ONE", "", "")], "record_id string, title string, authors string, arxiv_id string").withColumn("arrived_at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(src + "2")
    ingest.start(spark, src + "2", cat, sink, str(tmp_path / "cp")).awaitTermination()
    got = {r["record_id"]: r["outcome"] for r in spark.read.parquet(sink).collect()}
    assert got == {"r1": "exists", "r2": "merged", "r3": "new", "r4": "merged"}
