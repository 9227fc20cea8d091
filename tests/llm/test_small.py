"""The operators on small tables with nulls, ties, repeated rows, long texts and clashing columns."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import bpe, components, format_duplicates, golden, history, mixing, names, spam, topics
from quirelake.llm.titles import plain, spells, title_parts
from quirelake.session import spool

REC = "record_id string, venue string, year int, title string, normalized_title string, doi string, extra string, fp bigint"


def rec(i, title, doi=None, norm=None, venue="V", year=2024):
    return (i, venue, year, title, norm, doi, "x", 1)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_titles():
    assert title_parts("Ａ&nbsp;<b>Big</b> Net: for​m", None) == ["abignet", "form"]
    assert title_parts("N/A", "a b c") == ["abc"] and title_parts(None, None) == []
    assert spells("abcab", ["ab", "c", "ab"]) and spells("aab", ["a", "ab"]) and not spells("abcba", ["ab", "c", "ab"])
    assert plain("{\\emph{X}}") == "{{x}}"


def test_format_duplicates(spark):
    rows = [rec("b", "Alpha: Beta"), rec("a", "BETA — alpha"), rec("c", "alpha beta"), rec("d", None, norm="betaalpha"), rec("e", "Alpha: Beta", year=2023), rec("b", "Alpha: Beta"),
            rec("f", "Beta Alphas"), rec("g", "Editorial", "10.1/a"), rec("h", "editorial", "10.1/b"), rec("i", "Editorial!", "doi:10.1/A."), rec("j", None), rec(None, "Alpha: Beta"), rec("k", "x" * 200_000), rec("l", "X" * 200_000)]
    df = spark.createDataFrame(rows, REC)
    assert pairs(format_duplicates.format_duplicates(df)) == {("a", "b"), ("a", "c"), ("a", "d"), ("g", "i"), ("k", "l")}
    assert pairs(format_duplicates.copies_per_title(df)) == {("a", 3), ("g", 1), ("k", 1)}
    assert format_duplicates.format_duplicates(df.where("venue = 'none'")).count() == 0
    hot = spark.range(3000).select(F.col("id").cast("string").alias("record_id"), F.lit("V").alias("venue"), F.lit(2024).alias("year"), F.lit("One: Title").alias("title"), F.lit(None).cast("string").alias("normalized_title"), F.lit(None).cast("string").alias("doi"))
    assert format_duplicates.format_duplicates(hot).count() == 2999


GOLD = "record_id string, title string, authors string, abstract string, doi string, arxiv_id string, paper_url string, pdf_url string, track string, source_tier string, abstract_source_tier string, verification_status string, fetched_at string"


def gold(i, tier="official", abstract="a", fetched="2024-01-01", status="crosschecked", title="T"):
    return (i, title, "x", abstract, "", "N/A", None, "-", None, tier, tier, status, fetched)


def test_best_records(spark):
    rows = [gold("a"), gold("b", "Third-Party crosschecked"), gold("a"), gold("c"), gold("d"), gold("e"), gold("f", fetched="2024-01-01T01:00:00+01:00"), gold("g", status="Verified Official", tier="mirror"), gold("h", fetched=None, tier=None, status=None, abstract=None), gold("z")]
    df = spark.createDataFrame(rows, GOLD)
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "1"), ("c", "2"), ("d", "2"), ("e", "3"), ("g", "3"), ("f", "4"), ("h", "4"), ("z", "5"), ("q", "5"), (None, "6"), ("a", None)], "record_id string, entity_id string")
    assert pairs(golden.best_records(df, m)) == {("1", "a"), ("4", "f")}
    assert golden.best_records(df.where("false"), m).count() == 0
    assert [r["x"] for r in spark.createDataFrame([("2024-01-01",), ("2024-01-01 00:00:00",), ("2024-01-01T01:00:00+01:00",), ("2023-12-31T22:00:00-0200",), ("2024-01-01T00:00:00Z",)], "t string").select(golden.instant(F.col("t")).alias("x")).distinct().collect()] == [1704067200.0]
    s = {r["entity_id"]: r for r in golden.surviving_records(spark.createDataFrame([gold("a", "third_party_crosschecked", title="Old"), gold("b", title="New"), gold("c", title="new ")], GOLD), spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "record_id string, entity_id string")).collect()}
    assert s["1"]["title"] == "new" or s["1"]["title"] == "New"
    assert s["1"]["doi"] is None


def forest(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("most", [2_000_000, 7])
def test_components(spark, most):
    r = random.Random(1)
    edges = [(f"n{r.randrange(90):03}", f"n{r.randrange(90):03}") for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("hub", f"h{i:03}") for i in range(80)]
    clean = [(a, b) for a, b in edges if a != b]
    dirty = edges + [(" N001 ", "n002"), (None, "n1"), ("", "n2"), ("q", "q"), ("p000", "p001")]
    df = spark.createDataFrame(dirty, "a string, b string")
    assert pairs(components.components(df, "a", "b", most)) == forest([*clean, ("n001", "n002")])
    assert components.components(df.where("a = 'none'"), "a", "b").count() == 0


def test_bpe_against_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(2)
    texts = [None, "", " ", "a", "the the  the   the\n\n\n x", "<|endoftext|> hi", "it's we'll I'D 12345 ½ ٣", "\x1c\x1d a\x1fb\x85c", "\xa0 x  y  ", "𝒟🇪🇺👩‍🔬 实验表明", "xy" * 3000, "a" * 20_000, "word " * 30_000, "a\n b", "a \nb", " a ", "a\n "]
    texts += ["".join(r.choice("ab \n'.") for _ in range(r.randrange(60))) for _ in range(800)]
    texts += ["".join(chr(r.choice([r.randrange(128), r.randrange(128, 0x2FFF)])) for _ in range(r.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {x["doc_id"]: x["ids"] for x in bpe.encode(df, "doc_id", "text").collect()}
    want = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert all(got[i] == w for i, w in enumerate(want))
    assert bpe.encode(df.where("doc_id < 0"), "doc_id", "text").count() == 0
    assert {x["doc_id"]: x["n_tokens"] for x in bpe.token_counts(df, ["doc_id"], "text").collect()} == {i: len(w) for i, w in enumerate(want)}


def test_nearly_same():
    base = "guided radiance fields for camera pose estimation with few labels"
    for other in ("guided radiance feilds for camera pose estimaton with few labels", "the guided radiance fields in camera pose estimation using few labels", "guided radiance fields for camera pose estimation with few labels (extended abstract)", "guided fields radiance for camera pose estimation with few labels", "guided radiance fields for camera estimation with few labels", "guided radiance fields for camera pose est..."):
        assert history.nearly_same(base, other) and history.nearly_same(other, base), other
    for other in (base + " ii", base + ", part 2", base + " revisited", base + ": three years later", base + ": an independent replication", "guided radiance fields for camera pose estimation with weak priors", "bounded radiance fields for depth estimation with few labels"):
        assert not history.nearly_same(base, other), other


HIST = "record_id string, venue string, year int, paper_id string, doi string, title string, normalized_title string, authors string, release_id string, o string"


def hist_rows():
    t = "Guided Radiance Fields for Camera Pose Estimation with Few Labels"
    a = "Ann Lee; Bob May"
    return [
        ("a", "V", 2024, "p1", "10.1/a", t, None, a, "r1", "x"),
        ("b", "V", 2024, "id:P1", None, "Quite another title of a thing", None, "Zed Zoo", "r2", "x"),
        ("c", "V", 2024, "p3", "doi:10.1/A", "Some third title here", None, None, "r2", "x"),
        ("d", "V", 2024, "p4", None, t.upper() + ".", None, "Lee, Ann; B. May", "r2", "x"),
        ("e", "V", 2024, "p5", "", t.replace("Camera", "Camrea"), None, "Ann Lee and Bob May", "r3", "x"),
        ("f", "V", 2024, "p6", "10.9/z", t, None, a, "r3", "x"),
        ("g", "V", 2023, "p1", None, t, None, a, "r3", "x"),
        ("h", "V", 2024, "p8", None, t + " II", None, a, "r3", "x"),
        ("i", "V", 2024, "p9", None, "Editorial", None, None, "r1", "x"),
        ("j", "V", 2024, "p10", None, "Editorial", None, None, "r3", "x"),
        ("k", "V", 2024, "p11", None, t, None, "Carl Cole; Dora Dill", "r3", "x"),
        ("l", "V", 2024, None, None, None, None, None, "r3", "x"),
        ("m", "V", 2024, "p1", None, "Same release as its double", None, "Q R", "r1", "x"),
        ("n", "V", 2024, "p1", None, t, None, a, "unknown", "x"),
        ("b", "V", 2024, "id:P1", None, "Quite another title of a thing", None, "Zed Zoo", "r2", "x"),
    ]


@pytest.mark.parametrize("at_once", [True, False])
def test_history(spark, at_once, monkeypatch):
    monkeypatch.setattr(history, "MAX_RUNS", 2)
    rel = spark.createDataFrame([("r1", "2024-01-01"), ("r2", "2024-02-01T00:00:00Z"), ("r3", "2024-03-01"), ("r0", None)], "release_id string, created_at string")
    df = spark.createDataFrame(hist_rows(), HIST)
    h = history.History(spark)
    if at_once:
        got = {r[0] for r in h.accept(df, rel).collect()}
    else:
        got = set()
        for r in ("r1", "r2", "r3"):
            got |= {x[0] for x in h.accept(df.where(f"release_id = '{r}'"), rel).collect()}
        assert len(h.runs) <= 2
    # o has the title of d's paper and no authors; q, later, has authors
    late = spark.createDataFrame([("o", "V", 2024, None, None, "A title without authors for once", None, None, "r1", "x")], HIST), spark.createDataFrame([("q", "V", 2024, None, None, "A Title without Authors for once", None, "Ann Lee", "r3", "x")], HIST)
    two = history.History(spark)
    assert two.accept(late[0], rel).count() == 0 and [x[0] for x in two.accept(late[1], rel).collect()] == ["q"]
    # f has another DOI than a, but d, of a release before it, has its title and authors and no DOI
    assert got == {"b", "c", "d", "e", "f"}, got
    assert h.accept(df.where("false"), rel, keep=False).count() == 0


def test_history_is_packed(spark, tmp_path, monkeypatch):
    """Runs of a batch and compacted runs are written in the codec of _PACKED, and what waits for them too."""
    from pathlib import Path

    import pyarrow.parquet as pq

    monkeypatch.setattr(history, "MAX_RUNS", 1)
    waits = []
    monkeypatch.setattr(history, "spool", lambda df, name, *a, **options: waits.append((name, options.get("compression"))) or spool(df, name, *a, **options))
    rel = spark.createDataFrame([("r1", "2024-01-01"), ("r2", "2024-02-01"), ("r3", "2024-03-01")], "release_id string, created_at string")
    df = spark.createDataFrame(hist_rows(), HIST)
    h = history.History(spark, str(tmp_path / "history"))
    for r in ("r1", "r2", "r3"):
        h.accept(df.where(f"release_id = '{r}'"), rel).count()
    codecs = {(f.relative_to(tmp_path).parts[1], pq.ParquetFile(f).metadata.row_group(0).column(0).compression) for f in Path(tmp_path).rglob("*.parquet") if pq.ParquetFile(f).metadata.num_row_groups}
    assert {what for what, _ in codecs} == {"keys", "lists", "pairs", "rows"} and {c for _, c in codecs} == {"ZSTD"}
    assert {n for n, _ in waits} == {"batch", "lists", "batch-rows", "same-titles"} and {c for _, c in waits} == {"zstd"}


def test_names(spark):
    same = [["Theodore Falmoner", "Ted Falmoner", "T. Falmoner", "Falmoner, Theodore", "Falmoner Theodore", "THEODORE FALMONER", "Prof. Theodore V. Falmoner", "Theodroe Falmoner"], ["Vikan Working Group on Open Data", "The Vikan WG on Open Data", "Vikan WGOD", "Working Group on Open Data, Vikan"], ["Karl-Heinz Bømen", "Karl Heinz Bomen", "K.-H. Bømen"]]
    other = ["Teodor Galemon", "Anna Falmoner", "Vikan Center for Open Data", "Karl-Heinz A. Rovik", "Karl-Heinz B. Rovik", "J. Dorn", "Jane Dorn", "John Dorn"]
    rows = [(n,) for g in same for n in g for _ in range(1 if "roe" in n else 3)] + [(n,) for n in other] + [(None,), ("",), (" ",)]
    rows += [(f"Theodore {s}",) for s in ("Abel", "Cain", "Dean", "Egan")]
    got = pairs(names.same_names(spark.createDataFrame(rows, "author string")))
    want = {(a, b) for g in same for a in g for b in g if a < b}
    assert want - got == set()
    assert not any(set(p) & set(other) for p in got), got - want
    assert names.same_names(spark.createDataFrame([], "author string")).count() == 0


def test_nicknames_of_several_names(spark):
    rows = ["Ed Brown", "Edward Brown", "E. Brown", "Pat Kim", "Patrick Kim", "Ed Stone", "Eddie Stone", "Ed Hill", "Edgar Hill", "Edward Hill", "Vexa Laboratory for Open Data", "Vexa Laboratory for Opne Data", "Vexa Laboratory for Open Tools"]
    rows += [f"Zima Laboratory for Open Data {x}" for x in ("North", "South")] + ["Zima Laboratory for Open Data"]
    got = pairs(names.same_names(spark.createDataFrame([(n,) for n in rows], "author string")))
    want = {("E. Brown", "Ed Brown"), ("E. Brown", "Edward Brown"), ("Ed Brown", "Edward Brown"), ("Pat Kim", "Patrick Kim"), ("Ed Stone", "Eddie Stone"), ("Vexa Laboratory for Open Data", "Vexa Laboratory for Opne Data")}
    assert got == want, got ^ want


SENTENCE = "The committee depends on the way pixels interact with image crops, although frames matter as well. "


def test_pages(spark):
    prose = SENTENCE * 5 + "\n\n" + "We study crowd counting and ask how far anchor-free heads can carry it. " * 3
    bad = {
        "tags": " ".join(f"#tag{i % 7}" for i in range(90)),
        "words": "buy cheap journal Buy Cheap offer journal " * 30,
        "links": "\n".join(f"[call for papers](https://x{i}.example/a)" for i in range(40)),
        "urls": " ".join(f"https://x{i}.example/abc" for i in range(60)),
        "menu": "\n".join(["free paper download", "cheap poster printing", "call for papers"] * 20),
        "products": "\n".join(f"Voltra T-{i} 48GB | plagiarism remover | new | {i}.99" for i in range(30)),
        "mostly": SENTENCE + "\n\n" + "cheap gpu rental | paper tips | " * 60,
        "hidden": '<div style="display:none">' + "paper tips " * 100 + "</div>",
        "zh": "#目标检测 #语音合成 " * 40,
        "sentences": "The best cheap shoes and the best cheap bags for the best price online.\n" * 60,
        "template": "\n".join(f"Buy the cheap {w} of the year for you." for w in ("shoes", "bags", "hats", "maps", "pens", "cups") * 10),
        "calls": "Get textures now! Buy textures. New textures! Cheap textures online. " * 10,
    }
    good = {
        "prose": prose,
        "terms": prose + "\n\nIndex Terms: crowd counting, pixels, frames, anchor-free heads, image crops.",
        "code": prose + "\n```python\ndef step(x):\n    return x\n```\n" + prose,
        "list": "Reading list on pixels.\n\n1. [1] Kred E. Pixels Again. NODEX, 2019. https://x.example/1\n   " + prose,
        "zh": "与以往工作不同，本方法不需要目标检测。实验表明，深度估计明显优于隐私保护。" * 6,
        "noise": prose + " " + "a" * 900,
        "arabic": "تعتمد اللجنة على الطريقة التي تتفاعل بها الأجزاء مع الصور المقطوعة في هذا العمل الجديد\nتظهر التجارب أن النموذج المقترح يتفوق على الطرق السابقة بفارق واضح في جميع المهام المدروسة\nنناقش في القسم الأخير حدود هذه الدراسة وما يمكن أن يضيفه الباحثون إليها مستقبلا",
        "russian": "Комитет зависит от того, как пиксели взаимодействуют с фрагментами изображений. Эксперименты показывают, что предложенный подход заметно лучше прежних методов. " * 2,
    }
    rows = [(i, t) for i, t in enumerate([*bad.values(), *good.values(), None, "", "   \n "])] + [(0, bad["tags"])]
    got = {r[0] for r in spam.stuffed_pages(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("size", F.lit(1))).collect()}
    assert got == set(range(len(bad))), [([*bad, *good])[i] for i in got ^ set(range(len(bad)))]
    assert spam.stuffed_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_hmm_counts():
    m = spam.Hmm.initial()
    c = m.expected(["SSL", "T", "SSL"], np.array([1, 2, 1]))
    k = len(spam.STATES)
    assert np.isclose(c[:k].sum(), 4) and np.isclose(c[k : k + k * k].sum(), 4) and np.isclose(c[k + k * k :].sum(), 8)
    assert [len(x) for x in m.labels(["SSL", "", "T"])] == [3, 0, 1]


def test_topics(spark):
    words = {"vision": "pixels boxes crops frames", "graphs": "nodes edges subgraphs homophily", "speech": "voices tones pitch melodies"}
    r = random.Random(3)

    def about(*areas):
        s = [f"We study {' and '.join(r.sample(words[a].split(), 2))} with care." for _ in range(4) for a in areas]
        return " ".join(s)

    rows, labels = [], []
    for i in range(240):
        a = list(words)[i % 3]
        other = list(words)[(i + 1) % 3]
        text = about(a) + f" Unlike {r.choice(words[other].split())} the problem has no agreed metric."
        rows.append((f"r{i}", f"On {r.choice(words[a].split())}", None, text))
        labels.append((f"r{i}", f"e{i}", a))
    rows += [("two", "On pixels and edges", None, about("vision", "graphs")), ("front", "Editorial", None, ""), ("none", None, None, None), ("r0", *rows[0][1:])]
    df = spark.createDataFrame(rows, "record_id string, title string, normalized_title string, abstract string")
    m = spark.createDataFrame([(a, b) for a, b, _ in labels], "record_id string, entity_id string")
    lab = spark.createDataFrame([(b, a, 0) for _, b, a in labels[:120]], "entity_id string, area_id string, is_non_paper int")
    defs = spark.createDataFrame([(a,) for a in [*words, "other"]], "area_id string")
    got = {}
    for x in topics.assign(df, m, lab, defs).collect():
        got.setdefault(x["record_id"], set()).add(x["area_id"])
    right = sum(got.get(f"r{i}") == {list(words)[i % 3]} for i in range(240))
    assert right >= 228, right
    assert got["two"] == {"vision", "graphs"} and "front" not in got and "none" not in got
    assert topics.assign(df.where("false"), m, lab, defs).count() == 0
    # rounds make the records more likely; labels have no part in where topics begin, only in what they are called
    texts = topics.prepare(df)
    labelled = topics.labels(m, lab)
    before, _ = topics.start(texts, labelled, list(words))
    model = topics.fit(texts, labelled, list(words))
    assert topics.perplexity(texts, model) <= topics.perplexity(texts, before) + 1e-6
    turned = topics.labels(m, lab.withColumn("area_id", F.when(F.col("area_id") == "vision", "graphs").when(F.col("area_id") == "graphs", "vision").otherwise(F.col("area_id"))))
    again, _ = topics.start(texts, turned, list(words))
    assert again.words == before.words and np.allclose(again.weights, before.weights)
    assert {a for _, a, _ in topics.topic_terms(model)} >= set(words)


def test_mixture(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(50, 400))), ["Big-Source", "small", "other"][0 if i % 10 else 1] if i % 7 else "other") for i in range(400)]
    docs += [(1000, docs[1][1], "big_source"), (1001, None, "small"), (1002, "", "small"), (1003, "x y", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("big_source", 0.7, 1), ("small", 0.2, 3), ("absent", 0.3, 2), (None, 0.1, 1), ("small", 0.1, 9)], "source string, target_share double, max_repeats int")
    s = {x["source"]: x for x in mixing.shares(d, t).collect()}
    assert abs(s["big_source"]["reached_share"] - 0.7 / 0.9) < 0.03 and s["absent"]["tokens_used"] == 0
    assert s["small"]["most_uses"] <= 3
    m = mixing.mixture(d, t).cache()
    assert m.groupBy("source", "block", "use").count().where("count > 1").count() == 0
    assert m.where("size(ids) <> n_tokens").count() == 0
    assert mixing.mixture(d.where("false"), t).count() == 0 and mixing.mixture(d, t.where("false")).count() == 0


def test_mixing_parts():
    totals = [1000, 300, 7]
    shards = -(-sum(totals) // 64)
    seen = np.zeros(3, np.int64)
    for i in range(shards):
        c, b = mixing.split_counts(totals, shards, i, 64)
        assert (b == seen).all() and (i == shards - 1 or c.sum() == 64)
        seen += c
    assert seen.tolist() == totals
    for n in (1, 2, 3, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_queries_registered():
    from quirelake.llm import queries

    assert {f"p{i}_found" for i in (1, 2, 3, 4, 6, 7, 10)} | {"p8_ids", "p9_mixture"} <= set(queries.queries())
    assert json.dumps(sorted(queries.oracle_sql())) is not None


def test_same_authors():
    base = "elizabeth sukolok yasmin zarvueen"
    for other in (base, "sukolok zarvueen", "elizabeth sukolko yasmin zarvumen", "sukolko zarvumen", "yasmin sukolok zarvueen other"):
        assert history.same_authors(base, other) and history.same_authors(other, base), other
    for other in ("", "stakobun yasmin", "bimabok elizabeth jasmin zervonak"):
        assert not history.same_authors(base, other) and not history.same_authors(other, base), other
    assert not history.same_authors("", "")


def test_history_meets_every_list_of_authors(spark):
    words = [f"{a}{b}{c}ovik" for a in "bdfglmnprstv" for b in "aeiou" for c in "klmnr"]
    r = random.Random(5)
    rows = []
    for i in range(60):
        # only one of a dozen authors is left, or the list is mistyped throughout: few or no equal words
        people = [" ".join(r.sample(words, 2)) for _ in range(12)]
        rows += [(f"a{i}", "V", i, None, None, f"Counting grains of the {i} hills", None, "; ".join(people), "r1", None), (f"b{i}", "V", i, None, None, f"Counting grains of the {i} hills", None, people[r.randrange(12)], "r2", None)]
        rows += [(f"c{i}", "W", i, None, None, f"Wells and rivers of the {i} plain", None, "Yasmin Sukolok; Elizabeth Zarvueen", "r1", None), (f"d{i}", "W", i, None, None, f"Wells and rivers of the {i} plain", None, "Sukolko, Y.; E. Zarvumen", "r2", None)]
        # one given name in common makes no paper the same
        rows += [(f"e{i}", "X", i, None, None, f"Songs of the {i} forests", None, f"Yasmin {r.choice(words)}", "r1", None), (f"f{i}", "X", i, None, None, f"Songs of the {i} forests", None, "Yasmin Hqwertz", "r2", None)]
    df = spark.createDataFrame(rows, HIST)
    rel = spark.createDataFrame([("r1", "2024-01-01"), ("r2", "2024-02-01")], "release_id string, created_at string")
    got = {x[0] for x in history.History(spark).accept(df, rel).collect()}
    assert got == {f"{k}{i}" for k in "bd" for i in range(60)}, got


def test_releases_one_by_one_give_the_same(spark, monkeypatch):
    r = random.Random(8)
    words = [f"{a}{b}{c}ing" for a in "bdfgl" for b in "aeiou" for c in "klmnr"]
    people = [f"{a}{b}ovik" for a in ("sul", "tar", "gom", "pel") for b in ("ek", "on", "ut")]

    def title(base):
        w = list(base)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w))
            w[i] = w[i][:2] + w[i][3:] if r.random() < 0.5 else w[i][1] + w[i][0] + w[i][2:]
        return " ".join(w)

    bases = [r.sample(words, 6) for _ in range(40)]
    rows = [(f"x{i:03}", "V", r.randrange(3), None, r.choice([None, None, "10.1/a", "10.1/b"]), title(r.choice(bases)), None, "; ".join(f"{r.choice('AB')}nn {r.choice(people)}" for _ in range(2)) if r.random() < 0.9 else None, f"r{r.randrange(1, 4)}", None) for i in range(300)]
    df = spark.createDataFrame(rows, HIST)
    rel = spark.createDataFrame([(f"r{i}", f"2024-0{i}-01") for i in range(1, 4)], "release_id string, created_at string")
    at_once = {x[0] for x in history.History(spark).accept(df, rel, keep=False).collect()}
    monkeypatch.setattr(history, "MAX_RUNS", 2)
    monkeypatch.setattr(history, "LEAST_ROWS", 300)
    monkeypatch.setattr(history, "RANGE_ROWS", 500)
    h, one_by_one = history.History(spark), set()
    for i in range(1, 4):
        one_by_one |= {x[0] for x in h.accept(df.where(f"release_id = 'r{i}'"), rel).collect()}
    assert len(h.bounds) > 2 and len(h.runs) < 3
    assert one_by_one == at_once and 50 < len(at_once) < 300
    # many small ranges have the same pairs as one
    assert {x[0] for x in history.History(spark).accept(df, rel, keep=False).collect()} == at_once


def test_near_titles_beyond_common_words(spark):
    rows = [("a", "V", 1, None, None, "Sparse Depth Fusion Networks", None, "Ann Lee", "r1", None), ("b", "V", 1, None, None, "Sparce Depht Fusin Networks", None, "Ann Lee", "r2", None),
            ("c", "V", 2, None, None, "Counting Small Grains of River Sand", None, "Ann Lee", "r1", None), ("d", "V", 2, None, None, "Counting Smal Grains of River Sand", None, "Ann Lee", "r2", None), ("e", "V", 2, None, None, "Counting Smal Grains of River Sand", None, "Zed Zoo", "r2", None),
            ("f", "V", 3, None, None, "Counting Small Grains of River Sand", None, "Ann Lee", "r1", None), ("g", "V", 3, None, None, "Counting Small Grains of River Sand", None, "Zed Zoo", "r1", None), ("h", "V", 3, None, None, "Counting Smal Grains of River Sand", None, "Zed Zoo", "r2", None)]
    rel = spark.createDataFrame([("r1", "2024-01-01"), ("r2", "2024-02-01")], "release_id string, created_at string")
    assert {x[0] for x in history.History(spark).accept(spark.createDataFrame(rows, HIST), rel).collect()} == {"b", "d", "h"}


def test_letters_bound_loses_no_near_title():
    r = random.Random(9)
    words = [f"{a}{b}{c}ing" for a in "bdfgl" for b in "aeiou" for c in "klmnr"]
    near = 0
    for _ in range(4000):
        a = r.sample(words, 7)
        b = list(a)
        for _ in range(r.randrange(4)):
            i, k = r.randrange(len(b)), r.randrange(5)
            w = b[i]
            b[i] = (w[1:], w[:3] + "x" + w[3:], w[:2] + w[3:4] + w[2:3] + w[4:], w[:4] + "é" + w[5:], w)[k]
        if r.random() < 0.3:
            b = b[: r.randrange(4, 8)]
        x, y = " ".join(a), " ".join(b)
        if history.nearly_same(x, y):
            near += 1
            c = history._letter_counts(np.zeros(2, int), ["".join(history._content(x)), "".join(history._content(y))]).astype(int)
            assert min(np.maximum(c[0] - c[1], 0).sum(), np.maximum(c[1] - c[0], 0).sum()) <= history._NEAR
    assert near > 500


def test_parts_in_any_number(spark):
    rows = [rec("a", "One: Two: Three: Four: Five"), rec("b", "Two: One: Three: Four: Five"), rec("c", "five four three two one"), rec("d", "One: Two: Three: Four: Four"), rec("e", "A: BC"), rec("f", "AB: C"), rec("g", None, norm="abc"), rec("h", "x: x: y"), rec("i", "x: y: y"), rec("j", "y | X - x")]
    got = pairs(format_duplicates.format_duplicates(spark.createDataFrame(rows, REC)))
    assert {("a", "b"), ("a", "c"), ("h", "j")} <= got and not any("d" in p or "i" in p for p in got) and ("e", "f") not in got
    assert sum("g" in p for p in got) == 1


def test_format_duplicates_without_doi(spark):
    rows = [rec("a", "Editorial", "10.1/a"), rec("b", "EDITORIAL", "10.1/b"), rec("c", "editorial"), rec("d", "Editorial!"), rec("e", "Edi torial", "N/A"), rec("f", "Editorial.", "10.1/B")]
    assert pairs(format_duplicates.format_duplicates(spark.createDataFrame(rows, REC))) == {("b", "f"), ("c", "d"), ("c", "e")}


def test_queries_over_empty_tables(spark, tmp_path):
    from pathlib import Path

    from quirelake.llm import queries

    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no test data")
    for p in source.glob("*.parquet"):
        spark.read.parquet(str(p)).where("false").write.parquet(str(tmp_path / p.name))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_history_does_not_repeat_work(spark, monkeypatch):
    """Words are hashed once, listed names need no grammar, and titles out of reach no edit distance."""
    import pyarrow as pa

    from quirelake.operators import packed

    calls = {"hash": 0, "distance": 0, "affil": 0}

    def counting(name, f):
        def run(*args):
            calls[name] += 1
            return f(*args)

        return run

    # as many hashes as words and seeds, in the same order as before
    words = ["quiet", "nets", "under", "noise", "drift", "maps"]
    r = random.Random(4)
    titles = [" ".join(r.sample(words, 4)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 300), pa.array(range(300)), pa.array(titles), pa.array(["ann lee"] * 300), pa.array([1] * 300)], names=["block", "tkey", "title", "names", "first"])
    hashed = history._hash
    monkeypatch.setattr(history, "_hash", counting("hash", hashed))
    keys = pa.Table.from_batches(list(history._by_title(iter([batch])))).column("skey").to_pylist()
    people = pa.Table.from_batches(list(history._by_author(iter([batch])))).column("skey").to_pylist()
    assert calls["hash"] <= len(words) * history.WORD_ORDERS + 2 * 2
    n = history.WORD_ORDERS + 2
    for i, t in enumerate(titles):
        content = history._content(t)
        assert keys[n * i : n * i + n] == ["".join(content), "".join(content)[::-1], *[" ".join(sorted(content, key=lambda w, s=s: hashed(w, 100 + s))) for s in range(history.WORD_ORDERS)]]
        assert [p.split(" ")[0] for p in people[2 * i : 2 * i + 2]] == [f"{min(hashed(w, s) for w in ('ann', 'lee')):x}" for s in (0, 1)]
    # a list with commas and separators only
    monkeypatch.setattr(packed._Grammar, "affil", counting("affil", packed._Grammar.affil))
    assert packed.parse_packed("Lee, Ann; Bo Alexander | Cy Fernandez / Di Wu、Ed O'Hara") == [(x, 0) for x in ("Lee, Ann", "Bo Alexander", "Cy Fernandez", "Di Wu", "Ed O'Hara")]
    assert calls["affil"] == 0
    assert packed.parse_packed("Ann Lee and Bo Li") == [("Ann Lee", 0), ("Bo Li", 0)] and calls["affil"] > 0
    # a short title with few letters that the longer one has not, but nowhere near its beginning
    monkeypatch.setattr(history, "_distance", counting("distance", history._distance))
    long = "robust pixels for crowd counting under noise with sparse maps of quiet streets"
    assert not history.nearly_same("quiet streets of noise pixels counting crowds robustly", long) and calls["distance"] == 0
    assert history.nearly_same("robust pixles for crowd counting under noise with spa", long) and calls["distance"] > 0
    # ranges, also of rows whose way and block no bound has
    h = history.History.__new__(history.History)
    rows = [(w, b, k) for w in (0, 1, 2) for b in (-5, 3) for k in ("", "a", "m", "z")]
    for h.bounds in ([], [(1, -5, "m")], [(0, 3, "b"), (1, -5, "a"), (1, -5, "m"), (2, -9, "x")], rows[1:]):
        df = spark.createDataFrame([(w, b, k, 1, "t", 1) for w, b, k in rows], history._ROW_SCHEMA)
        assert {(x["way"], x["block"], x["skey"]): x["range"] for x in h.ranged(df).collect()} == {x: sum(b <= x for b in h.bounds) for x in rows}


def test_history_takes_short_ways(monkeypatch):
    """Plain lists of authors need no grammar, and a pair is looked at whatever others of its titles gave."""
    import pyarrow as pa

    calls, read = [], history.parse_packed
    monkeypatch.setattr(history, "parse_packed", lambda text: calls.append(text) or read(text))

    def by_grammar(text):
        return {w for name, _ in read(text) for w in history._name_words(name)}

    plain_lists = ["Ann Lee; Bo O'Hara", "Lee, Ann, Jean-Luc Ølsen | Dr. X. Wu", "['Ann Lee', 'Bo Li']", '"Lee, Ann"; Beth Li Jr.', "李 小龙、王 Wei", "Ann Lee & Bo Li / Cy Wu\nDi Fu", "n/a; Ann Lee", "N/A", ""]
    for text in plain_lists:
        assert history.author_words(text) == by_grammar(text), text
    assert calls == []
    others = ["Ann Lee and Bo Li", "Ann Lee (Tor Lab); Bo Li", "Lee Working Group on Maps; Ann Lee", "Tor Ctr for Maps", "unknown; Ann Lee", "None", 'Ann"Lee', "['Ann''Bo']", "Univ of Tor"]
    for text in others:
        assert history.author_words(text) == by_grammar(text), text
    assert calls == others
    # two titles of one key, of which the second is nearly the third; the first has its letters only
    titles = ["sparse depht fusion networks", "krowten noisuf htped esraps", "sparse depth fusion networks"]
    keys = ["".join(history._content(t)) for t in titles]
    one, new = np.ones(3, np.int64), np.ones(3, bool)
    assert history._near_rows(np.zeros(3, np.int32), one, np.array([1, 1, 2]), one, new, keys, pa.array(titles)) == {(1, 2, 1)}
    # letters of more than one byte have one number, and hashes of authors none
    counts = history._letter_counts(np.array([0, history.WORD_ORDERS + 2]), ["aé李a", "1f a李"])
    assert counts.sum(1).tolist() == [4, 2] and counts[0, ord("a") % 32] == 2 and counts[0, ord("é") % 32] == 1 and counts[1, ord("李") % 32] == 1


def test_history_gives_ranges_in_one_step(spark):
    """Rows get their range in the step that makes them, as they would in one of its own."""
    h = history.History.__new__(history.History)
    h.bounds = [(1, 3, "e"), (5, 3, ""), (6, 3, "2")]
    lists = spark.createDataFrame([(3, i, f"{t} maps", "ann lee", False, i) for i, t in enumerate(["quiet", "noisy", "extended abstract"])], "block long, tkey long, title string, names string, generic boolean, o_any long")
    placed = history.sorted_rows(lists, h._place())
    assert sorted(placed.collect()) == sorted(h.ranged(history.sorted_rows(lists)).collect()) and {r["range"] for r in placed.collect()} == {0, 1, 2, 3}
    assert placed._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2


def test_inference_in_blocks():
    """Documents are inferred in small blocks, with the proportions that the plain steps give."""
    import tracemalloc

    r = np.random.default_rng(2)
    model = topics.Model([f"w{i}" for i in range(500)], r.gamma(0.3, size=(topics.TOPICS, 500)) + topics.BETA, set())
    docs = [[" ".join(f"w{i}" for i in r.integers(0, 500, n))] for n in [*r.integers(1, 160, 998), 0, 9_000]]
    doc, _, word, weight = model.tokens(docs)
    tracemalloc.start()
    gamma, theta, c = model.infer(len(docs), doc, word, weight)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * len(word) * topics.TOPICS * 4, peak  # less than one number for each token and topic
    given = theta[doc] * model.phi[word] * c[:, None]
    assert np.allclose(given.sum(1), weight, rtol=1e-4)
    assert np.allclose(gamma[998], topics.ALPHA)
    for d in (0, 500, 999):
        b, w, g = model.phi[word[doc == d]], weight[doc == d], np.full((1, topics.TOPICS), topics.ALPHA + 1)
        for _ in range(topics.STEPS):
            x = np.exp(topics._digamma(g)) * b
            x /= x.sum(1, keepdims=True)
            g = topics.ALPHA + (x * w[:, None]).sum(0, keepdims=True)
        assert np.allclose(gamma[d], g[0], rtol=1e-3, atol=1e-3) and np.allclose(given[doc == d], x * w[:, None], atol=1e-3)


def test_plain_pages_take_plain_patterns(monkeypatch):
    """Lines of ASCII are read by the patterns for them, with the same result; sentences and noise are found as before."""
    import re

    page = "The nets don't drift (much). We test 1,200 low-cost maps! " * 8 + "\n# Notes\nshort tags; more tags; odd tags; new tags\n"
    before = spam.observe(page + "é")

    class Refused:
        def findall(self, text):
            raise AssertionError(text)

    with monkeypatch.context() as m:
        m.setattr(spam, "_WORD", Refused())
        m.setattr(spam, "_STOP", Refused())
        seen, sizes = spam.observe(page)
    assert seen == before[0][: len(seen)] and sizes == before[1][: len(seen)]
    old = re.compile(r"(?<=[.!?。！？…؟۔।])[\"'”’)\]]*\s+|(?<=[。！？])")
    for line in (page, 'A "b." c?! d.', "。。甲。” 乙！ 丙… d. ", "", ". ", "a.b"):
        assert list(spam._sentences(line)) == old.split(line)
    for n in range(6, 14):
        for lead in range(7):
            assert spam._noisy("x" * lead + "y" * n + " z") == (n >= 10) == spam._noisy("é" * lead + "中" * n + " z")
