"""Every query of the core against its SQL, over the smallest data folder."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return f"{float(v):.6f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, con, name):
    mine = QUERIES[name](spark, small)
    theirs = con.execute(SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(names, theirs.fetchall())


#: Columns that tell the rows of the queries without SQL apart; these are held against brute force elsewhere in the tests.
KEYS = {
    "chunk_documents": ["chunk_id"],
    "chunk_sections": ["doc_id", "section"],
    "er_stable_ids": ["n_records"],
    "match_fuzzy_titles": ["id", "place"],
    "match_merged_lists": ["block"],
    "p5_flags": None,
    "p5_found": ["record_id", "pos"],
    "vector_clusters": ["id"],
    "vector_kmeans_agreement": ["ari"],
}


def test_every_query_is_held_against_something():
    assert set(QUERIES) - set(SQL) == set(KEYS)


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows(spark, small, name):
    """Rows come out, whole and told apart by their key."""
    out = QUERIES[name](spark, small).cache()
    n = out.count()
    assert n > 0
    if KEYS[name]:
        assert out.select(*KEYS[name]).distinct().count() == n
        assert out.where(" OR ".join(f"{k} IS NULL" for k in KEYS[name])).count() == 0
    out.unpersist()


def test_split_loses_no_text(spark, small):
    from quirelake.operators.vectors import split_documents
    from quirelake.session import table

    d = table(spark, small, "documents")
    letters = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s#]+", ""))
    whole = {r["doc_id"]: r["n"] for r in d.select("doc_id", letters("text").alias("n")).collect()}
    for r in split_documents(d, 100_000_000).groupBy("doc_id").agg(F.sum(letters("text")).alias("n")).collect():
        assert r["n"] == whole[r["doc_id"]], r


def test_fuzzy_titles_against_all_pairs(spark, small):
    """Titles at 0.9 or more are found though only those with a word in common are compared."""
    from difflib import SequenceMatcher

    from quirelake.operators.matching import fuzzy_titles
    from quirelake.plans.base import records

    rows = [r for r in records(spark, small, "title", "venue", "year").where("title IS NOT NULL AND title <> ''").orderBy("record_id").collect()]
    a, b = rows[::2], rows[1::2]
    frame = lambda rs: spark.createDataFrame([(r["record_id"], r["title"], f"{r['venue']}|{r['year']}") for r in rs], "id string, title string, block string")
    got = {(r["id"], r["other"]) for r in fuzzy_titles(frame(a), frame(b), "block", 0.9, 1000).collect()}
    want = {(x["record_id"], y["record_id"]) for x in a for y in b if (x["venue"], x["year"]) == (y["venue"], y["year"]) and SequenceMatcher(None, x["title"].lower(), y["title"].lower()).ratio() >= 0.9}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_fuzzy_titles_of_large_blocks(spark):
    """Two thousand by two thousand titles with a word in common end soon, with the partners that were put among them."""
    import random
    import time
    from difflib import SequenceMatcher

    from quirelake.operators.matching import fuzzy_titles

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randint(3, 8)))
    long = " ".join(word() for _ in range(60))
    odd = ["transformers " + "e" * 30 + " of thirty", "transformers " + "e" * 33 + " of thirty", "Transformers İstanbul Ünïcode 学习", "transformers i̇stanbul ünïcode 学", f"transformers {long}", f"transformers {long} x", "transformers", "Transformers.", "\U0001d54f transformers of \U0001f600", "", "short"]
    a = [f"{word()} transformers {word()} {word()} {word()}" for _ in range(2000)] + odd
    b = [f"{word()} transformers {word()} {word()} {word()}" for _ in range(1950)] + [t[:-1] + "q" for t in a[:25]] + a[25:50] + odd[::-1]
    left = [(f"l{i}", t, "v") for i, t in enumerate(a)] + [("l0", a[0], "v"), ("l1", a[1], "empty"), (None, a[2], "v"), ("l3", None, "v"), ("l4", a[4], None)]
    right = [(f"r{i:04d}", t, "v") for i, t in enumerate(b)] + [("r0000", b[0], "v"), ("r9", b[1953], "v"), ("r8", "", "empty"), ("r7", None, "v")]
    frame = lambda rs: spark.createDataFrame(rs, "id string, title string, block string")
    began = time.time()
    got = sorted((r["id"] or "", r["other"], r["ratio"], r["place"]) for r in fuzzy_titles(frame(left), frame(right), "block", 0.9, 2).collect())
    assert time.time() - began < 60
    want = []
    for x, t, block in set(left):
        scored = []
        for y, u, other in set(right[1950:]):
            if not t or not u or block != "v" or other != "v" or "transformers" not in t.lower() or "transformers" not in u.lower():
                continue
            m = SequenceMatcher(None, t.lower(), u.lower())
            if m.real_quick_ratio() >= 0.9 and m.quick_ratio() >= 0.9 and m.ratio() >= 0.9:
                scored.append((-m.ratio(), y))
        want += [(x or "", y, round(-r, 6), place) for place, (r, y) in enumerate(sorted(scored)[:2], 1)]
    assert got == sorted(want) and len(got) > 50


def test_fuzzy_titles_share_no_long_word(spark, monkeypatch):
    """Without worded every pair of titles in a block is found, whatever their words; packs and their bounds of size lose none."""
    import random
    from difflib import SequenceMatcher

    from quirelake.operators import matching

    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeinorst") for _ in range(rnd.randint(1, 5)))
    a = [" ".join(word() for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    a += ["Learnnig Grpahs Efficeintly", "On the Art of Odd Sums", "深度学习 与 图 网络 的 综述", "short", "x", "e" * 90, "İ" * 20, " a b ", "N/A", "", None, "  ", "Unknown"]
    typing = lambda t: "".join(c for c in t if rnd.random() > 0.06) + rnd.choice(["", "q", "."])
    b = [typing(t) if t else t for t in a] + a + ["Learning Graphs Efficiently", "on the art of odd sum", "深度学习 与 图 网络 之 综述", "e" * 110, "e" * 74, "e" * 73, "i̇" * 20]
    frame = lambda rs: spark.createDataFrame(rs, "id string, title string, block string")
    left = [(f"l{i:03d}", t, "v" if i % 7 else "w") for i, t in enumerate(a)] + [("l900", a[1], None), ("l001", a[1], "v")]
    right = [(f"r{i:03d}", t, "v" if i % 5 else "w") for i, t in enumerate(b)] + [("r900", a[1], None), ("r901", a[1], "elsewhere")]
    monkeypatch.setattr(matching, "_PACK", 4)
    for least, best in ((0.9, 1000), (0.9, 1), (0.6, 2)):
        want = []
        for x, t, block in set(left):
            scored = []
            for y, u, other in set(right):
                if block and block == other and t and u and t.strip().lower() not in ("", "n/a", "unknown") and u.strip().lower() not in ("", "n/a", "unknown"):
                    r = SequenceMatcher(None, t.lower(), u.lower()).ratio()
                    if r >= least:
                        scored.append((-r, y))
            want += [(x, y, round(-r, 6), place) for place, (r, y) in enumerate(sorted(scored)[:best], 1)]
        got = matching.fuzzy_titles(frame(left), frame(right), "block", least, best, worded=False)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 40


def test_match_fuzzy_titles_without_long_words(spark, small, tmp_path):
    """The query has a row for every later record with a partner at 0.9, also where no title has a word of six letters."""
    from difflib import SequenceMatcher

    cut = F.regexp_replace("title", r"(\p{L}{5})\p{L}+", "$1")
    spark.read.parquet(f"{small}/paper_records.parquet").withColumn("title", cut).write.parquet(f"{tmp_path}/paper_records.parquet")
    spark.read.parquet(f"{small}/data_releases.parquet").write.parquet(f"{tmp_path}/data_releases.parquet")
    first = spark.read.parquet(f"{tmp_path}/data_releases.parquet").where("status = 'ready'").orderBy("created_at").first()["release_id"]
    rows = spark.read.parquet(f"{tmp_path}/paper_records.parquet").where("trim(title) <> ''").select("record_id", "title", "venue", "year", "release_id").distinct().collect()
    near = lambda x, y: SequenceMatcher(None, x["title"].lower(), y["title"].lower()).ratio() >= 0.9
    want = {x["record_id"] for x in rows for y in rows if x["release_id"] and x["release_id"] != first and y["release_id"] == first and (x["venue"], x["year"]) == (y["venue"], y["year"]) and near(x, y)}
    assert {r["id"] for r in QUERIES["match_fuzzy_titles"](spark, str(tmp_path)).collect()} == want and want
