import hashlib

from quirelake.operators import entities as E
from quirelake.operators import graph, matching

COLS = "record_id string, doi string, arxiv_id string, paper_url string, pdf_url string, title string, authors string, venue string, year int"


def rec(i, doi="", arxiv="", title="A long enough title of a paper", authors="Ann Lee; Bob May"):
    return (i, doi, arxiv, "", "", title, authors, "V", 2024)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["entity_id"], set()).add(r["record_id"])
    return sorted(map(sorted, out.values()))


def test_merge_rules(spark):
    rows = [rec("a", "10.1/X"), rec("b", "doi:10.1/x."), rec("c", arxiv="2401.00001", title="T one of the papers here"), rec("d", arxiv="arXiv:2401.00001v2", title="T one of the papers here"), rec("e", arxiv="2402.00001", title="First title of these"), rec("f", arxiv="2402.00001", title="Other title of these"), rec("g", doi=None, title=None, authors=None)]
    res = E.resolve(spark.createDataFrame(rows, COLS))
    assert groups(res.memberships) == [["a", "b"], ["c", "d"], ["e"], ["f"], ["g"]]
    assert {(r["left_id"], r["right_id"]) for r in res.candidates.where("reason = 'arxiv_conflict'").collect()} == {("e", "f")}


def test_identity_guard(spark):
    rows = [rec("a", "10.1/x"), rec("b", "10.1/x"), rec("c", "10.1/x", title="Another title of a longer kind"), rec("d", "10.2/y")]
    prior = spark.createDataFrame([("a", "ape_1"), ("b", "ape_2"), ("d", "ape_3")], "record_id string, entity_id string")
    res = E.resolve(spark.createDataFrame(rows, COLS), prior)
    of = {r["record_id"]: r["entity_id"] for r in res.memberships.collect()}
    assert of["a"] == "ape_1" and of["b"] == "ape_2" and of["d"] == "ape_3"
    assert of["c"] in ("ape_1", "ape_2")
    assert res.candidates.where("reason LIKE '%identity_review'").count() >= 1


def test_ids_are_unique(spark):
    # a keeps the earlier id that is the hash of b's DOI; b, new, must not take it too
    h = "ape_" + hashlib.sha256(b"doi:10.2/b").hexdigest()[:24]
    rows = [rec("a", "10.1/a"), rec("b", "10.2/b"), rec("c", "10.3/c"), rec("d", "10.3/c", title="Another title of a longer kind"), rec("e", "10.4/e", title="Some other title of a longer kind")]
    prior = spark.createDataFrame([("a", h), ("c", "ape_x"), ("d", "ape_x"), ("e", "ape_x")], "record_id string, entity_id string")
    of = {r["record_id"]: r["entity_id"] for r in E.resolve(spark.createDataFrame(rows, COLS), prior).memberships.collect()}
    assert of["a"] == h and of["b"] != h and of["c"] == of["d"] == "ape_x" and len({of[x] for x in "abce"}) == 4
    # of two that want one id the smaller takes its next
    votes = spark.createDataFrame([("p", "i1", 3), ("p", "i2", 1), ("q", "i1", 2), ("q", "i2", 1), ("r", "i1", 1)], "component string, prior string, votes bigint")
    sizes = spark.createDataFrame([("p", 5), ("q", 4), ("r", 1)], "component string, n bigint")
    assert {(r["component"], r["prior"]) for r in E.kept_ids(votes, sizes).collect()} == {("p", "i1"), ("q", "i2")}


def test_conflicts_between_all_titles(spark):
    rows = [rec(i, arxiv="2402.00001", title=f"{t} title of these longer papers") for i, t in (("e", "First"), ("f", "Other"), ("g", "Third"), ("h", "Third"))]
    c = E.resolve(spark.createDataFrame(rows, COLS)).candidates
    assert {(r["left_id"], r["right_id"]) for r in c.where("reason = 'arxiv_conflict'").collect()} == {("e", "f"), ("e", "g"), ("f", "g"), ("g", "h")}
    assert {r["reason"] for r in c.collect()} == {"arxiv_conflict", "exact_title_authors"}


def test_long_chains(spark):
    rows = [(f"n{i:04}", f"n{i + 1:04}") for i in range(1000)] + [("x", "y"), ("y", "x")]
    got = {r["old"]: (r["current"], r["in_cycle"]) for r in graph.followed_aliases(spark.createDataFrame(rows, "old string, new string"), "old", "new").collect()}
    assert all(got[f"n{i:04}"] == ("n1000", False) for i in range(1000)) and got["x"][1] and got["y"][1]


def test_components(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "d"), ("x", "y"), ("y", "z"), (None, "q"), ("c", "b")] + [("hub", f"n{i:03}") for i in range(200)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == "a" and got["z"] == "x" and "d" not in got and "q" not in got
    assert {got[f"n{i:03}"] for i in range(200)} == {"hub"}
    assert {got[f"p{i:02}"] for i in range(41)} == {"p00"}


def test_alias_chains(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", "q"), (None, "r")]
    got = {r["old"]: (r["current"], r["in_cycle"]) for r in graph.followed_aliases(spark.createDataFrame(rows, "old string, new string"), "old", "new").collect()}
    assert got["a"] == ("d", False) and got["b"] == ("d", False) and got["x"][1] and "q" not in got


def test_reconcile(spark):
    schema = "id string, title string, doi string, paper_url string, pdf_url string, block string"
    ref = spark.createDataFrame([("r1", "T1", "10.1/A", "", "", "b"), ("r2", "Same", "", "http://www.x.org/p/", "", "b"), ("r3", "Twice", "", "", "", "b"), ("r4", "None", "", "", "", "b"), ("r5", "Alone", None, None, None, "b")], schema)
    loc = spark.createDataFrame([("l1", "Else", "doi:10.1/a", "", "", "b"), ("l2", "Other", "", "https://x.org/p?x=1", "", "b"), ("l3", "Twice", "", "", "", "b"), ("l4", "twice!", "", "", "", "b"), ("l5", "Alone", "", "", "", "b"), ("l6", "Left", "", "", "", "b")], schema)
    got = {(r["ref_id"], r["status"], r["local_id"]) for r in matching.reconcile(ref, loc, ["block"]).collect()}
    assert {("r1", "matched", "l1"), ("r2", "matched", "l2"), ("r3", "ambiguous", None), ("r4", "missing", None), ("r5", "matched", "l5"), (None, "local_only", "l6")} <= got


def test_merge_incoming(spark):
    schema = "id string, block string, paper_id string, doi string, paper_url string, title string"
    old = spark.createDataFrame([("o1", "b", "1", "10.1/a", "", "Alpha"), ("o2", "b", "2", "", "", "Beta"), ("o3", "b", "3", "10.3/c", "", "Gamma"), ("o4", "b", "4", "", "", "Beta two"), ("o5", "b", "5", "", "", "beta TWO")], schema)
    new = spark.createDataFrame([("n1", "b", "1", "", "", "Alpha"), ("n2", "b", "2", "", "", "Changed"), ("n3", "b", "9", "10.9/z", "", "Gamma"), ("n4", "b", "8", "", "", "Beta two"), ("n5", "b", "7", "", "", "Delta"), ("n6", "b", "3", "10.8/q", "", "Gamma")], schema)
    got = {r["id"]: r["outcome"] for r in matching.merge_outcomes(old, new).collect()}
    assert got == {"n1": "filled", "n2": "identifier_title_conflict", "n3": "added", "n4": "ambiguous_match", "n5": "added", "n6": "title_doi_conflict"}


LIST = "id string, block string, paper_id string, doi string, paper_url string, title string, list_status string, authors string, arxiv_id string, pdf_url string, abstract string, abstract_source_name string, abstract_source_url string, abstract_source_tier string, abstract_fetched_at string"


def row(i, paper_id, doi="", url="", title="T", authors="", abstract="", status="final"):
    return (i, "b", paper_id, doi, url, title, status, authors, "", "", abstract, "s" if abstract else "", "", "", "")


def test_merged_lists(spark):
    old = [row("o1", "1", "10.1/a", title="Alpha"), row("o2", "2", url="http://x.org/shared", title="Beta"), row("o3", "3", url="http://x.org/shared", title="Gamma"), row("o4", "4", title="Old name"), row("o5", "5", title="Unmet")]
    new = [row("n1", "1", title="Alpha", authors="N/A", abstract="first"), row("n2", "1", "10.1/a", title="Alpha", authors="Ann Lee", abstract="second"), row("n3", "9", url="http://x.org/shared", title="Delta", status="rolling"), row("n4", "8", "10.5/e", title="Epsilon"), row("n5", "7", "10.5/e", title="Epsilon again"), row("n6", "4", title="New name"), row("n7", "5", "10.6/f", title="Zeta", authors="X"), row("n1", "1", title="Alpha", authors="N/A", abstract="first")]
    approved = spark.createDataFrame([("o4", "New name"), ("o5", "Else")], "old_id string, title string")
    m = matching.merge_incoming(spark.createDataFrame(old, LIST), spark.createDataFrame(new, LIST), approved)
    got = {r["id"]: r["outcome"] for r in m.outcomes.collect()}
    # an address that two old rows share is no identity; n5 joins n4, which came before it
    assert got == {"n1": "filled", "n2": "filled", "n3": "added", "n4": "added", "n5": "joined", "n6": "filled", "n7": "identifier_title_conflict"}
    rows = {r["id"]: r for r in m.rows.collect()}
    assert set(rows) == {"o1", "o2", "o3", "o4", "o5", "n3", "n4"}
    assert (rows["o1"]["authors"], rows["o1"]["abstract"], rows["o1"]["abstract_source_name"]) == ("Ann Lee", "first", "s")
    assert rows["o4"]["title"] == "New name" and rows["o5"]["title"] == "Unmet" and not rows["o5"]["authors"]
    assert rows["n3"]["list_status"] == "final" and {r["id"] for r in m.not_in_source.collect()} == {"o2", "o3", "o5"}
    taken = matching.merge_incoming(spark.createDataFrame(old, LIST), spark.createDataFrame([row("n9", "2", url="http://q.org", title="Beta"), row("n8", "3", title="Brand new")], LIST))
    assert {r["id"]: r["outcome"] for r in taken.outcomes.collect()} == {"n9": "filled", "n8": "identifier_title_conflict"}
    empty = spark.createDataFrame([], LIST)
    assert matching.merge_incoming(spark.createDataFrame(old, LIST), empty).rows.count() == 5 and matching.merge_incoming(empty, spark.createDataFrame(new, LIST)).rows.count() >= 4


def test_collapsed_and_gates(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "x", "2"), ("b", "x", "1"), ("b", "y", "1")], "k string, v string, w string")
    rows, conflicts = matching.collapsed(df, ["k"], ["v"])
    assert [r["k"] for r in rows.collect()] == ["a"] and [(r["k"], r["n_v"]) for r in conflicts.collect()] == [("b", 2)]
    g = "l_id string, r_id string, l_title string, r_title string, l_authors string, r_authors string, l_year int, r_year int, l_kind string, r_kind string, l_doi string, r_doi string, l_venue string, r_venue string, r_published string, cutoff string, l_forum string, r_forum string"
    base = dict(l_id="1", r_id="2", l_title="A title", r_title="a Title!", l_authors="Ann Lee; Bob May", r_authors="Lee Ann", l_year=2024, r_year=2024, l_kind="p", r_kind="p", l_doi=None, r_doi=None, l_venue="V", r_venue="v", r_published="2024-05-01", cutoff="2024-06-01", l_forum=None, r_forum=None)
    cases = [base | {"r_id": "1"}, base | {"l_id": "3", "l_doi": "10.1/A", "r_doi": "doi:10.1/a", "r_title": "Other"}, base | {"l_id": "4", "l_doi": "10.1/A", "r_doi": "10.1/a", "r_title": "Other", "r_published": "2024-07-01"}, base | {"l_id": "5"}, base | {"l_id": "6", "r_authors": "Zed Zoo", "l_forum": "q", "r_forum": "q"}, base | {"l_id": "7", "r_authors": "Zed Zoo"}, base | {"l_id": "8", "r_authors": None, "r_year": 2020}]
    got = {r["l_id"]: r["gate"] for r in matching.gates(spark.createDataFrame([tuple(c[x.split()[0]] for x in g.split(", ")) for c in cases], g)).collect()}
    assert got == {"1": "id_title", "3": "doi", "4": None, "5": "title_author", "6": "forum", "7": "title_year", "8": None}
