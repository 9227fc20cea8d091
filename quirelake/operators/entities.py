"""Entity resolution: records that are one paper become one entity with a stable id."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions.columns import arxiv_key, forum_key
from quirelake.functions.missing import doi_key, is_missing
from quirelake.functions.text import plain_title_key_col, title_key_col
from quirelake.operators.graph import connected_components
from quirelake.session import spool

MIN_TITLE, MIN_AUTHORS, MAX_CANDIDATES = 24, 6, 10
# In this order of trust the methods of a merged entity are named.
METHODS = ("reviewed_publication", "doi", "arxiv", "openreview")


@dataclass
class Resolution:
    """memberships: record_id, entity_id, match_method, confidence; candidates: left_id, right_id, reason, confidence, candidate_id; aliases: alias_entity_id, entity_id."""

    memberships: DataFrame
    candidates: DataFrame
    aliases: DataFrame


def keyed(records: DataFrame) -> DataFrame:
    """record_id with the keys that records are matched by; empty text for a missing key."""
    none = F.lit("")
    return records.where("record_id IS NOT NULL").select(
        "record_id",
        F.coalesce(doi_key(F.col("doi")), none).alias("doi"),
        F.when(is_missing(F.col("arxiv_id")), none).otherwise(arxiv_key(F.col("arxiv_id"))).alias("arxiv"),
        F.coalesce(forum_key(F.col("paper_url"), F.col("pdf_url")), none).alias("openreview"),
        plain_title_key_col(F.col("title")).alias("title"),
        F.when(is_missing(F.col("authors")), none).otherwise(title_key_col(F.col("authors"))).alias("people"),
    )


def _star(k: DataFrame, key: str) -> DataFrame:
    """Each record of a key linked with the key's first record."""
    some = k.where(F.col(key) != "")
    anchor = some.groupBy(key).agg(F.min("record_id").alias("anchor"), F.count("*").alias("n"), F.countDistinct("title").alias("titles"), F.countDistinct(F.when(F.col("people") != "", F.col("people"))).alias("author_sets"))
    return some.join(anchor.where("n > 1"), key).where("record_id <> anchor").select(F.col("anchor").alias("a"), F.col("record_id").alias("b"), F.col(key).alias("value"), ((F.col("titles") == 1) & (F.col("author_sets") <= 1)).alias("compatible"))


def _conflicts(k: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """left_id and right_id of records that share a key but not title and authors.

    Every pair of different titles and authors of a key, between the first record of each, and each other record with the first of
    its own title and authors: no link between different papers is lost, and copies are not expanded.
    """
    keys = links.where("NOT compatible").select(F.col("value").alias(key)).distinct()
    some = k.join(keys, key, "left_semi")
    kinds = some.groupBy(key, "title", "people").agg(F.min("record_id").alias("first"))
    x, y = kinds.alias("x"), kinds.alias("y")
    between = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.first") < F.col("y.first"))).select(F.col("x.first").alias("left_id"), F.col("y.first").alias("right_id"))
    within = some.join(kinds, [key, "title", "people"]).where("record_id <> first").select(F.col("first").alias("left_id"), F.col("record_id").alias("right_id"))
    return between.unionAll(within)


def candidate_id(left: Column, right: Column, method: Column) -> Column:
    return F.concat(F.lit("review_"), F.substring(F.sha2(F.concat(left, F.chr(F.lit(0)), right, F.chr(F.lit(0)), method), 256), 1, 24))


def _replayed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges one contested component edge by edge; an edge between two earlier identities is refused."""
    parent: dict[str, str] = {}
    prior: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for side, p in (("a", "prior_a"), ("b", "prior_b")):
        for r, e in zip(pdf[side], pdf[p], strict=True):
            if e:
                prior[r] = e
    refused = []
    for e in pdf.sort_values(["phase", "a", "b"]).itertuples():
        x, y = find(e.a), find(e.b)
        if x == y:
            continue
        if prior.get(x) and prior.get(y) and prior[x] != prior[y]:
            refused.append((e.a, e.b, e.phase))
            continue
        lo, hi = min(x, y), max(x, y)
        parent[hi] = lo
        if prior.get(hi) and not prior.get(lo):
            prior[lo] = prior[hi]
    nodes = sorted(set(pdf.a) | set(pdf.b))
    rows = [(n, find(n), None, None) for n in nodes] + [(None, None, f"{a}\t{b}", int(p)) for a, b, p in refused]
    return pd.DataFrame(rows, columns=["node", "component", "refused", "phase"])


def resolve(records: DataFrame, previous: DataFrame | None = None, reviewed: DataFrame | None = None) -> Resolution:
    """Records with one DOI are one entity; so are those with one arXiv or forum id, if title and authors agree.

    previous (record_id, entity_id) keeps identities: components that hold several of them are merged again
    edge by edge, refusing those between two; reviewed (a, b) are pairs known to be one paper. Records that share
    an id but not title or authors, and records of equal title and authors in small groups, become
    candidates for review. Entities keep the id most of their records had, the largest entity first, the others the
    next of their earlier ids that is left; new ones take a hash of their smallest DOI or, where that is taken, of their
    first record. No two entities have one id. Repeated rows must be removed before.
    """
    k = spool(keyed(records), "entity-keys")
    groups = {m: spool(_star(k, c), f"star-{c}") for m, c in (("doi", "doi"), ("arxiv", "arxiv"), ("openreview", "openreview"))}
    edges = groups["doi"].select("a", "b", F.lit(1).alias("phase"))
    for phase, m in ((2, "arxiv"), (3, "openreview")):
        edges = edges.unionAll(groups[m].where("compatible").select("a", "b", F.lit(phase).alias("phase")))
    if reviewed is not None:
        edges = edges.unionAll(reviewed.select("a", "b", F.lit(0).alias("phase")))
    edges = spool(edges.where("a <> b").distinct(), "entity-edges")
    parts = spool(connected_components(edges), "entity-components")
    refused = None
    if previous is not None:
        prior = previous.select(F.col("record_id").alias("node"), F.col("entity_id").alias("prior")).where("prior IS NOT NULL").groupBy("node").agg(F.min("prior").alias("prior"))
        held = parts.join(prior, "node").groupBy("component").agg(F.countDistinct("prior").alias("n")).where("n > 1").select("component")
        inside = edges.join(parts.withColumnRenamed("node", "a"), "a").join(held, "component")
        pa_, pb_ = prior.withColumnsRenamed({"node": "a", "prior": "prior_a"}), prior.withColumnsRenamed({"node": "b", "prior": "prior_b"})
        replay = spool(inside.join(pa_, "a", "left").join(pb_, "b", "left").groupBy("component").applyInPandas(lambda pdf: _replayed(pdf.fillna({"prior_a": "", "prior_b": ""})), "node string, component string, refused string, phase int"), "entity-replay")
        parts = parts.join(held, "component", "left_anti").select("node", "component").unionAll(replay.where("node IS NOT NULL").select("node", "component"))
        refused = replay.where("refused IS NOT NULL").select(F.split("refused", "\t")[0].alias("left_id"), F.split("refused", "\t")[1].alias("right_id"), F.concat(F.element_at(F.array(*map(F.lit, METHODS)), F.col("phase") + 1), F.lit("_identity_review")).alias("reason"), F.lit("high").alias("confidence"))
    placed = k.join(parts, k.record_id == parts.node, "left").select("record_id", F.coalesce("component", "record_id").alias("component"), "doi")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.min(F.when(F.col("doi") != "", F.col("doi"))).alias("doi"), F.min("record_id").alias("first"))
    seed = F.coalesce(F.concat(F.lit("doi:"), F.col("doi")), F.concat(F.lit("record:"), F.col("first")))
    fresh = F.concat(F.lit("ape_"), F.substring(F.sha2(seed, 256), 1, 24))
    named = sizes.withColumn("entity_id", fresh)
    aliases = records.sparkSession.createDataFrame([], "alias_entity_id string, entity_id string")
    votes = None
    if previous is not None:
        votes = spool(placed.join(previous.select("record_id", F.col("entity_id").alias("prior")).where("prior IS NOT NULL").distinct(), "record_id").groupBy("component", "prior").agg(F.count("*").alias("votes")), "entity-votes")
        named = sizes.join(kept_ids(votes, sizes), "component", "left").withColumn("entity_id", F.coalesce("prior", fresh))
    named = spool(_unique(named, votes), "entity-ids")
    if votes is not None:
        aliases = votes.join(named.select("component", "entity_id"), "component").where("prior <> entity_id").select(F.col("prior").alias("alias_entity_id"), "entity_id").distinct()
    method = edges.select(F.col("a").alias("record_id"), "phase").unionAll(edges.select(F.col("b"), "phase")).join(placed.select("record_id", "component"), "record_id").groupBy("component").agg(F.min("phase").alias("phase"))
    how = F.element_at(F.array(*map(F.lit, METHODS)), F.col("phase") + 1)
    of = placed.join(named.select("component", "entity_id", "n"), "component").join(method, "component", "left")
    memberships = spool(of.select("record_id", "entity_id", F.when(F.col("n") == 1, "singleton").otherwise(how).alias("match_method"), F.when(F.col("n") == 1, "single").when(F.col("phase") <= 1, "exact").otherwise("high").alias("confidence")), "entity-memberships")

    pairs = [_conflicts(k, m, groups[m]).select("left_id", "right_id", F.lit(f"{m}_conflict").alias("reason"), F.lit("conflict").alias("confidence")) for m in ("arxiv", "openreview")]
    if refused is not None:
        pairs.append(refused)
    alike = k.where((F.length("title") >= MIN_TITLE) & (F.length("people") >= MIN_AUTHORS)).select("record_id", F.xxhash64("title", "people").alias("h1"), F.md5(F.concat("title", "people")).alias("h2"))
    few = alike.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(f"n BETWEEN 2 AND {MAX_CANDIDATES}")
    small = alike.join(few, ["h1", "h2"])
    x, y = small.alias("x"), small.alias("y")
    pairs.append(x.join(y, (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & (F.col("x.record_id") < F.col("y.record_id"))).select(F.col("x.record_id").alias("left_id"), F.col("y.record_id").alias("right_id"), F.lit("exact_title_authors").alias("reason"), F.lit("high").alias("confidence")))
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionAll(p)
    e = memberships.select("record_id", "entity_id")
    across = every.join(e.withColumnsRenamed({"record_id": "left_id", "entity_id": "le"}), "left_id").join(e.withColumnsRenamed({"record_id": "right_id", "entity_id": "re"}), "right_id").where("le <> re")
    candidates = across.select("left_id", "right_id", "reason", "confidence", candidate_id(F.col("left_id"), F.col("right_id"), F.col("reason")).alias("candidate_id")).distinct()
    return Resolution(memberships, candidates, aliases)


def kept_ids(votes: DataFrame, sizes: DataFrame) -> DataFrame:
    """component and prior: the earlier id each component keeps. votes: component, prior, votes; sizes: component, n.

    Components ask for their earlier ids, most votes first; an id goes to the largest that asks, and the others ask for their
    next, until none is turned away. As all ids prefer components in one order, that is what giving out the ids to
    the largest component first comes to.
    """
    asks = votes.join(sizes.select("component", "n"), "component").withColumn("turn", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("votes"), "prior")))
    asks = spool(asks, "entity-asks")
    at = spool(asks.groupBy("component").agg(F.lit(1).alias("turn")), "entity-turns")
    while True:
        now = asks.join(at, ["component", "turn"])
        owner = now.groupBy("prior").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
        turned_away = now.select("component", "turn").join(owner.select("component"), "component", "left_anti")
        if turned_away.isEmpty():
            return owner
        at = spool(at.join(turned_away.select("component", F.lit(1).alias("away")), "component", "left").select("component", (F.col("turn") + F.coalesce("away", F.lit(0))).alias("turn")), "entity-turns")


def _unique(named: DataFrame, votes: DataFrame | None) -> DataFrame:
    """component, entity_id and n, with the new ids that another component has, or had before, made from the first record instead."""
    n = named.withColumn("kept", F.col("prior").isNotNull() if votes is not None else F.lit(False))
    old = votes.select(F.col("prior").alias("entity_id"), F.lit(True).alias("taken")).distinct() if votes is not None else None
    twice = n.where("NOT kept").groupBy("entity_id").agg(F.max_by("component", F.struct("n", "component")).alias("owner"))
    j = n.join(twice, "entity_id", "left")
    j = j.join(old, "entity_id", "left") if old is not None else j.withColumn("taken", F.lit(None).cast("boolean"))
    second = F.concat(F.lit("ape_"), F.substring(F.sha2(F.concat(F.lit("record:"), F.col("first")), 256), 1, 24))
    again = ~F.col("kept") & (F.coalesce("taken", F.lit(False)) | (F.col("owner") != F.col("component")))
    out = j.select("component", F.when(again, second).otherwise(F.col("entity_id")).alias("entity_id"), "n")
    return out


def entity_rows(memberships: DataFrame, records: DataFrame) -> DataFrame:
    """entity_id, first and last year, numbers of records and venues, status."""
    j = memberships.join(records.select("record_id", "venue", "year"), "record_id")
    return j.groupBy("entity_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("record_count"), F.countDistinct("venue").alias("venue_count")).withColumn("entity_status", F.when(F.col("record_count") > 1, "merged").otherwise("single"))


def alias_status(ids: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, entity_id and status of each id: current, alias (then entity_id is the current one) or missing."""
    e = entities.select(F.col("entity_id").alias("cur")).distinct()
    a = aliases.groupBy("old").agg(F.min("current").alias("to"))
    j = ids.select("id").distinct().join(e, F.col("id") == F.col("cur"), "left").join(a, F.col("id") == F.col("old"), "left")
    return j.select("id", F.coalesce("cur", "to").alias("entity_id"), F.when(F.col("cur").isNotNull(), "current").when(F.col("to").isNotNull(), "alias").otherwise("missing").alias("status"))
