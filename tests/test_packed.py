import pytest
from hypothesis import given
from hypothesis import strategies as st

from quirelake.operators.packed import BRACKET, PARENS, QUOTE, parse_packed, split_packed

CASES = {
    "Tamara V. Rivam; Vlal, A.": ["Tamara V. Rivam", "Vlal, A."],
    '"Deloton, V.", "Jean-Luc Tut"': ["Deloton, V.", "Jean-Luc Tut"],
    "['Pavel G' 'Anton V']": ["Pavel G", "Anton V"],
    "['A B', 'C D']": ["A B", "C D"],
    '["X Y","Z, Q."]': ["X Y", "Z, Q."],
    "A B, C D, and E F": ["A B", "C D", "E F"],
    "L N, L D & L J. L": ["L N", "L D", "L J. L"],
    "Drust, A.": ["Drust, A."],
    "X Y (Poly (North Campus), Ardel); X. G": ["X Y", "X. G"],
    "X Y (Poly (North (Hall (4))), Ardel); X. G": ["X Y", "X. G"],
    "Johnson and Johnson; A B": ["Johnson and Johnson", "A B"],
    "Johnson and Johnston": ["Johnson", "Johnston"],
    "K Institute of Language and Reasoning and Tom B": ["K Institute of Language and Reasoning", "Tom B"],
    "; A B;; C D ; ": ["A B", "C D"],
    "A B / C D | E F\nG H": ["A B", "C D", "E F", "G H"],
    "A B、C D": ["A B", "C D"],
    'U K; "Center for Computing, Kren"; R L': ["U K", "Center for Computing, Kren", "R L"],
    "Laboratory for Search and Planning, Kren; Robert L": ["Laboratory for Search and Planning, Kren", "Robert L"],
}


@pytest.mark.parametrize("text", CASES)
def test_names(text):
    assert [n for n, _ in parse_packed(text)] == CASES[text]


@pytest.mark.parametrize("text", [None, "", "  ", "N/A", "tbd", "-", " null "])
def test_missing(text):
    assert parse_packed(text) == []


def test_flags():
    assert parse_packed('["A B; C D')[0][1] & BRACKET
    assert parse_packed('"A B; C D')[0][1] & QUOTE
    assert parse_packed("A B; C D")[0][1] == 0
    assert parse_packed("A B (p (q (r (s)))); C D") == [("A B", 0), ("C D", 0)]
    assert parse_packed("A B (p (q; C D")[0][1] & PARENS and parse_packed("(" * 50_000 + "A")[0][1] & PARENS
    # a quote without its end goes back to a bare value; the separators in it count again
    assert parse_packed('"A B; C D') == [("A B", QUOTE), ("C D", QUOTE)]


@given(st.lists(st.from_regex(r"[A-Z][a-z]{2,8} [A-Z][a-z]{2,8}", fullmatch=True), min_size=1, max_size=6), st.sampled_from(["; ", ";", " | ", "|", "\n", "; \t", "；", "、", " / ", ", ", " & ", " and "]))
def test_round_trip(names, separator):
    assert [n for n, _ in parse_packed(separator.join(names))] == names


@given(st.lists(st.from_regex(r"[A-Z][a-z]{2,8}, [A-Z]\.", fullmatch=True), min_size=1, max_size=6))
def test_quoted_round_trip(names):
    assert [n for n, _ in parse_packed(", ".join(f'"{n}"' for n in names))] == names


@given(st.text(max_size=80))
def test_never_fails(text):
    parse_packed(text)


def test_split(spark):
    rows = [("a", "X Y; Z Q", 1), ("b", None, 2), ("c", "", 3), ("a", "X Y; Z Q", 1), ("d", "X Y; " * 20_000, 4)]
    df = spark.createDataFrame(rows, "id string, people string, pos int")  # pos clashes with an output column
    out = split_packed(df, "people", ["id"], "author").collect()
    assert sorted((r["id"], r["pos"], r["author"]) for r in out if r["id"] == "a") == [("a", 0, "X Y"), ("a", 0, "X Y"), ("a", 1, "Z Q"), ("a", 1, "Z Q")]
    assert sum(r["id"] == "d" for r in out) == 20_000
    assert not {"b", "c"} & {r["id"] for r in out}
    assert split_packed(df.where("id = 'x'"), "people", ["id"], "author").count() == 0
