import json

import pytest

from quirelake.plans.base import Filters
from quirelake.plans.capabilities import call, cap_get_paper, compare, cooccurrence, get_paper
from quirelake.session import table


def test_normalized():
    f = Filters.of({"venues": "CAVIR", "years": ["2024", 2025], "query": " Video "})
    assert f.venues == ("CAVIR",) and f.years == (2024, 2025) and f.query == "Video"
    with pytest.raises(ValueError, match="unknown"):
        Filters.of({"nope": 1})
    with pytest.raises(ValueError, match="50"):
        Filters.of({"venues": ["v"] * 51})
    with pytest.raises(ValueError, match="200"):
        Filters.of({"query": "x" * 201})


def test_envelope(spark, small):
    assert call(spark, small, "nope")["ok"] is False
    assert call(spark, small, "count_papers", {"filters": {"bad": 1}})["ok"] is False
    got = call(spark, small, "count_papers", {"filters": {"years": [2024]}})
    assert got["ok"] and all(set(r) == {"key", "n"} for r in got["data"])
    with pytest.raises(ValueError):
        compare(spark, small, {"one": {}})
    with pytest.raises(ValueError):
        cooccurrence(spark, small, None, "area", "area")


def test_every_paper_in_full(spark, small):
    got = {r["entity_id"]: r for r in cap_get_paper(spark, small).collect()}
    wanted = {r[0] for r in table(spark, small, "paper_entities").select("entity_id").distinct().collect()}
    assert set(got) == wanted and len(wanted) > 1
    m = table(spark, small, "entity_memberships").select("record_id", "entity_id").distinct()
    n = m.join(table(spark, small, "paper_records").select("record_id").distinct(), "record_id").groupBy("entity_id").count()
    assert {k: len(json.loads(r["appearances"])) for k, r in got.items() if r["appearances"]} == {r[0]: r[1] for r in n.collect() if r[0] in wanted}
    last = max(wanted)
    assert [r["entity_id"] for r in get_paper(spark, small, last).collect()] == [last] and get_paper(spark, small, "none").count() == 0


def test_tables_without_repeats(spark, small):
    import shutil

    from quirelake import session

    first = session.released(spark, small, "paper_entities")
    assert first.count() == table(spark, small, "paper_entities").distinct().count()
    path = next(v for k, v in session._once.items() if k[3] == "released-paper_entities" and k[2] == small)
    shutil.rmtree(path.removeprefix("file:").replace("//", "/"))
    assert session.released(spark, small, "paper_entities").count() == first.sparkSession.read.parquet(f"{small}/paper_entities.parquet").distinct().count()
