import sqlite3

import pytest
from pyspark.sql import functions as F

from quirelake.functions.text import query_tokens, search_text
from quirelake.operators import search as S

ROWS = [
    ("SuperResolution of 4KAgent images", "We study super resolution", "Ann Lee"),
    ("Naïve graph transformers", "graph graph networks", "Bob"),
    ("Graph learning", "a superresolution method for graphs", "Graph Man"),
    ("Retrieval QA", "question answering with dense passage retrieval", "Q"),
    ("Other", "nothing here", "Z"),
    ("Large language models", "llms", None),
    ("图像 denoising", None, ""),
]


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(f"r{i}", t, a, p, "", "", "") for i, (t, a, p) in enumerate(ROWS)], "record_id string, title string, abstract string, authors string, paper_id string, doi string, arxiv_id string")
    return S.build(df), df


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(title, abstract, authors, paper_id, doi, arxiv_id, tokenize=\"unicode61 remove_diacritics 2\")")
    for r in ROWS:
        c.execute("insert into f values(?, ?, ?, '', '', '')", [search_text(x) for x in r])
    return c


@pytest.mark.parametrize(("query", "match"), [("graph", '("graph"*)'), ("sr", '("sr"* OR "super resolution" OR "superresolution")'), ("graph net", '("graph"*) AND ("net"*)'), ("qa", '("qa"* OR "question answering")'), ("llm", '("llm"* OR "large language model")'), ("nothing of the graph", '("nothing"*) AND ("graph"*)')])
def test_bm25(index, fts, query, match):
    got = sorted((r["record_id"], round(r["rank"], 9)) for r in S.search(index[0], S.match_of(S.terms_of(query))).collect())
    want = sorted((f"r{i - 1}", round(x, 9)) for i, x in fts.execute("select rowid, bm25(f, 3, 2, 1, 10, 10, 10) from f where f match ?", (match,)))
    assert got == want


def test_relaxed(index):
    match, kept, dropped = S.relaxed(index[0], "graph unheardof transformers retrieval")
    assert dropped[0] == "unheardof" and set(kept) | set(dropped) == {"graph", "unheardof", "transformers", "retrieval"} and set(kept) == {"graph", "transformers"}
    assert S.search(index[0], match).count() > 0
    assert S.relaxed(index[0], "的")[1] == []
    assert S.resolve(index[0], "graph nothing")[1] == "relaxed_any"


def test_tokens():
    assert query_tokens("SuperResolution 4KAgent GPT4 super4K") == ["super", "resolution", "4k", "agent", "gpt4", "super", "4k"]
    assert query_tokens("naïve") == ["na", "ve"]


def test_add_and_remove(index, spark):
    ix, df = index
    again = ix.added(df)
    assert again.lengths.count() == len(ROWS)
    assert ix.without(spark.createDataFrame([("r1",)], "record_id string")).lengths.count() == len(ROWS) - 1


def test_metadata_and_lookup(index, spark):
    ix, df = index
    assert S.match_metadata(ix, " ")["mode"] == "browse"
    assert S.match_metadata(ix, "的") == {"mode": "unsupported_tokens", "terms": [], "ignored": ["的"]}
    assert S.match_metadata(ix, "图像 graph")["mode"] == "all_terms" and S.match_metadata(ix, "graph nothing")["mode"] == "relaxed_any"
    known = df.withColumn("doi", F.when(F.col("record_id") == "r2", "10.1/A").otherwise(""))
    assert [r[0] for r in S.looked_up_or_found(known, ix, "10.1/a").collect()] == ["r2"]
    assert {r[0] for r in S.looked_up_or_found(known, ix, "graph").collect()} == {"r1", "r2"}
