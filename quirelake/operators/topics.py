"""Rule-based topics and tags: a configured tree of topics is compiled to column expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quirelake.functions.text import phrase_text

STRONG, WEAK, BENCHMARK = 3.0, 1.0, 3.0
MAX_EVIDENCE, MAX_EXTRAS = 16, 2


@dataclass(frozen=True)
class Topic:
    """A leaf of the tree with its signals; terms are phrases."""

    topic_id: str
    family: str
    strong: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    benchmarks: tuple[str, ...] = ()
    together: tuple[tuple[tuple[str, ...], float], ...] = ()
    anchors: tuple[str, ...] = ()
    threshold: float = 3.0
    concrete: bool = False


@dataclass(frozen=True)
class Tag:
    tag: str
    terms: tuple[str, ...]


def load_topics(rows: list[dict]) -> list[Topic]:
    """Topics of a configuration, refused if an id repeats or a topic has no signal."""
    out = [Topic(r["topic_id"], r["family"], *(tuple(map(phrase_text, r.get(k, ()))) for k in ("strong", "weak", "benchmarks")), tuple((tuple(map(phrase_text, c["all"])), float(c["weight"])) for c in r.get("together", ())), tuple(map(phrase_text, r.get("anchors", ()))), float(r.get("threshold", 3.0)), bool(r.get("concrete", False))) for r in rows]
    ids = [t.topic_id for t in out]
    if len(set(ids)) != len(ids):
        raise ValueError("a topic id repeats")
    for t in out:
        if not (t.strong or t.weak or t.benchmarks or t.together):
            raise ValueError(f"{t.topic_id} has no signal")
    return out


def _has(text: str, term: str) -> Column:
    return F.contains(F.concat(F.lit(" "), F.col(text), F.lit(" ")), F.lit(f" {term} "))


def _anchored(t: Topic) -> Column:
    out = F.lit(not t.anchors)
    for a in t.anchors:
        for form in (a,) if " " in a or a.endswith("s") else (a, a + "s"):
            out = out | _has("title", form) | _has("abstract", form)
    return out


def _signal(kind: str, name: str, hit_title: Column, hit_abstract: Column, weight: float, multiplier: float) -> Column:
    points = F.when(hit_title, F.lit(weight * multiplier)).when(hit_abstract, F.lit(weight))
    return F.when(points.isNotNull(), F.struct(F.lit(name).alias("signal"), F.when(hit_title, "title").otherwise("abstract").alias("field"), points.alias("points"), F.lit(kind).alias("kind")))


def _evidence(t: Topic, multiplier: float) -> Column:
    gate = _anchored(t)
    rows = []
    for kind, terms, weight in (("strong", t.strong, STRONG), ("weak", t.weak, WEAK)):
        rows += [F.when(gate, _signal(kind, w, _has("title", w), _has("abstract", w), weight, multiplier)) for w in terms]
    for terms, weight in t.together:
        ti, ab = F.lit(True), F.lit(True)
        for w in terms:
            ti, ab = ti & _has("title", w), ab & _has("abstract", w)
        rows.append(F.when(gate, _signal("cooccurrence", "+".join(terms), ti, ab, weight, multiplier)))
    rows += [_signal("benchmark", w, _has("title", w), _has("abstract", w), BENCHMARK, multiplier) for w in t.benchmarks]
    return F.filter(F.array(*rows), lambda e: e.isNotNull())


def classify(texts: DataFrame, topics: list[Topic], multiplier: float = 2.0) -> DataFrame:
    """entity_id, topic_id, score, role (primary or extra) and evidence, from entity_id, title and abstract.

    title and abstract are phrase texts (functions.text.phrase_text_col); null counts as empty. Each topic that reaches its
    threshold is kept; if a concrete family scores at least as well as all others, the others go. The best
    score, then the order of the configuration, makes the primary topic; up to two of other families with
    more than benchmarks as evidence are extras. All topics are scored in one pass, within the JVM.
    """
    scored = [F.struct(F.lit(i).alias("place"), F.lit(t.topic_id).alias("topic_id"), F.lit(t.family).alias("family"), F.lit(t.concrete).alias("concrete"), F.lit(t.threshold).alias("threshold"), _evidence(t, multiplier).alias("evidence")) for i, t in enumerate(topics)]
    base = texts.select("entity_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"))
    c = base.select("entity_id", F.explode(F.array(*scored)).alias("t")).select("entity_id", "t.*")
    c = c.withColumn("score", F.round(F.aggregate("evidence", F.lit(0.0), lambda s, e: s + e["points"]), 2)).where("score >= threshold AND size(evidence) > 0")
    per = Window.partitionBy("entity_id")
    best_concrete = F.coalesce(F.max(F.when(F.col("concrete"), F.col("score"))).over(per), F.lit(-1.0))
    best_other = F.coalesce(F.max(F.when(~F.col("concrete"), F.col("score"))).over(per), F.lit(-1.0))
    c = c.withColumn("task_first", (best_concrete >= best_other) & (best_concrete >= 0)).where("concrete OR NOT task_first")
    ordered = per.orderBy(F.desc("score"), "place")
    c = c.withColumn("rank", F.row_number().over(ordered)).withColumn("primary_family", F.first("family").over(ordered))
    solid = F.exists("evidence", lambda e: e["kind"] != "benchmark")
    extra = (F.col("rank") > 1) & (F.col("family") != F.col("primary_family")) & solid
    c = c.withColumn("extra", extra).withColumn("nth", F.sum(F.col("extra").cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    kept = c.where((F.col("rank") == 1) | (F.col("extra") & (F.col("nth") <= MAX_EXTRAS)))
    shown = F.slice(F.array_sort("evidence", lambda x, y: F.when(x["points"] > y["points"], -1).when(x["points"] < y["points"], 1).when(x["signal"] < y["signal"], -1).when(x["signal"] > y["signal"], 1).otherwise(0)), 1, MAX_EVIDENCE)
    return kept.select("entity_id", "topic_id", "score", F.when(F.col("rank") == 1, "primary").otherwise("extra").alias("role"), shown.alias("evidence"))


def scan_tags(texts: DataFrame, tags: list[Tag]) -> DataFrame:
    """entity_id, tag, term and field of the first listed term of each tag that a text has, the title before the abstract."""
    rows = []
    for t in tags:
        hit = F.lit(None).cast("struct<term:string,field:string>")
        for w in reversed(t.terms):
            p = phrase_text(w)
            for field in ("abstract", "title"):
                hit = F.when(_has(field, p), F.struct(F.lit(w).alias("term"), F.lit(field).alias("field"))).otherwise(hit)
        rows.append(F.struct(F.lit(t.tag).alias("tag"), hit.alias("hit")))
    base = texts.select("entity_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"))
    return base.select("entity_id", F.explode(F.array(*rows)).alias("t")).where("t.hit IS NOT NULL").select("entity_id", "t.tag", "t.hit.term", "t.hit.field")


def ancestors(spark: SparkSession, parents: DataFrame, most_depth: int = 20) -> DataFrame:
    """topic_id, ancestor_id and depth (0 for itself) of a tree given as topic_id and parent_topic_id (null or '' for roots)."""
    p = parents.select("topic_id", F.nullif("parent_topic_id", F.lit("")).alias("parent"))
    out = p.select("topic_id", F.col("topic_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    step, depth = out, 0
    while depth < most_depth:
        depth += 1
        step = step.alias("s").join(p.alias("p"), F.col("s.ancestor_id") == F.col("p.topic_id")).where("p.parent IS NOT NULL").select("s.topic_id", F.col("p.parent").alias("ancestor_id"), F.lit(depth).alias("depth"))
        if step.isEmpty():
            return out
        out = out.unionAll(step)
    raise ValueError("the topics form a cycle or are too deep")


def entity_texts(members: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id, title and abstract: the distinct titles and abstracts of an entity's records, canonical first, joined by newlines."""
    j = members.join(records, "record_id").groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct((1 - F.coalesce("is_canonical", F.lit(0))).alias("o"), "record_id", "title", "abstract"))).alias("r"))
    text = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("r", lambda x: x[c]), lambda t: t.isNotNull() & (t != ""))), "\n")
    return j.select("entity_id", text("title").alias("title"), text("abstract").alias("abstract"))


def without_terms(topics: list[Topic], removed: dict[str, list[str]]) -> list[Topic]:
    """The topics without the removed terms, by topic."""
    gone = {t: {phrase_text(w) for w in ws} for t, ws in removed.items()}
    keep = lambda t, ws: tuple(w for w in ws if w not in gone.get(t, ()))
    return [replace(t, strong=keep(t.topic_id, t.strong), weak=keep(t.topic_id, t.weak), benchmarks=keep(t.topic_id, t.benchmarks)) for t in topics]


def simulated(texts: DataFrame, topics: list[Topic], removed: dict[str, list[str]]) -> DataFrame:
    """Of each topic its primary entities before and after the terms are removed, and how many it keeps."""
    run = lambda ts, name: classify(texts, ts).where("role = 'primary'").select("entity_id", F.col("topic_id").alias(name))
    j = run(topics, "before").join(run(without_terms(topics, removed), "after"), "entity_id", "full")
    long = j.select(F.explode(F.array_distinct(F.array_compact(F.array("before", "after")))).alias("topic_id"), "before", "after")
    is_ = lambda c: F.coalesce(F.col(c) == F.col("topic_id"), F.lit(False))
    return long.groupBy("topic_id").agg(F.count_if(is_("before")).alias("n_before"), F.count_if(is_("after")).alias("n_after"), F.count_if(is_("before") & is_("after")).alias("kept"))


def run_record(version: str, release_id: str, topics: list[Topic]) -> dict[str, str]:
    """What a run is known by: the same version, release and topics have the same id."""
    digest = hashlib.sha256("\n".join(map(repr, topics)).encode()).hexdigest()
    return {"run_id": "run_" + hashlib.sha256("\0".join((version, release_id, digest)).encode()).hexdigest()[:16], "version": version, "release_id": release_id, "config_digest": digest}
