"""Joins by several keys with rules on how many partners there may be, and merges that fill gaps only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from quirelake.functions.columns import any_of
from quirelake.functions.missing import doi_key, is_missing, present
from quirelake.functions.text import plain_title_key_col
from quirelake.operators.graph import connected_components
from quirelake.session import spool


def url_key(c: Column) -> Column:
    """An address without scheme, www, trailing slash, query and case."""
    u = F.lower(F.trim(c))
    u = F.regexp_replace(u, r"^https?://(?:www\.)?", "")
    return F.when(~is_missing(c), F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/+$", ""))


def reconcile(reference: DataFrame, local: DataFrame, within: list[str]) -> DataFrame:
    """ref_id, status (matched, ambiguous, missing) and local_id of each reference row; local rows without partner as local_only.

    Both sides have id, title, doi, paper_url, pdf_url and the columns of within. Rows match by DOI or address;
    a reference row without such a partner by its exact title key, if that is unique on the local side.
    Several partners make it ambiguous. Null keys match nothing; repeated rows count once.
    """

    def keys(df: DataFrame) -> DataFrame:
        k = F.array(F.concat(F.lit("doi:"), doi_key(F.col("doi"))), F.concat(F.lit("url:"), url_key(F.col("paper_url"))), F.concat(F.lit("url:"), url_key(F.col("pdf_url"))))
        return df.select("id", *within, F.explode(F.filter(k, lambda x: x.isNotNull())).alias("key")).distinct()

    on = [*within, "key"]
    by_id = keys(reference).withColumnRenamed("id", "ref_id").join(keys(local).withColumnRenamed("id", "local_id"), on).select("ref_id", "local_id").distinct()
    found = by_id.groupBy("ref_id").agg(F.count("*").alias("n"), F.min("local_id").alias("local_id"))
    ref = reference.select(F.col("id").alias("ref_id"), *within, plain_title_key_col(F.col("title")).alias("tkey")).distinct()
    titles = local.select("id", *within, plain_title_key_col(F.col("title")).alias("tkey")).where("tkey <> ''").distinct().groupBy(*within, "tkey").agg(F.countDistinct("id").alias("tn"), F.min("id").alias("tid"))
    j = ref.join(found, "ref_id", "left").join(titles, [*within, "tkey"], "left")
    n = F.coalesce("n", "tn", F.lit(0))
    status = F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("missing")
    rows = j.select("ref_id", status.alias("status"), F.when(n == 1, F.coalesce("local_id", "tid")).alias("local_id"))
    taken = by_id.select("local_id").unionAll(rows.where("local_id IS NOT NULL").select("local_id"))
    only = local.select(F.col("id").alias("local_id")).distinct().join(taken, "local_id", "left_anti").select(F.lit(None).cast("string").alias("ref_id"), F.lit("local_only").alias("status"), "local_id")
    return rows.unionAll(only)


def unique_index(df: DataFrame, key: Column, value: str) -> DataFrame:
    """key and value of the keys that have one value only."""
    return df.select(key.alias("key"), F.col(value).alias("value")).where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("other")).where("value = other").select("key", "value")


def first_of_keys(df: DataFrame, source: DataFrame, keys: list[tuple[str, Column, Column]], value: str) -> DataFrame:
    """df with the value of the first key, in their order, that leads to exactly one value of the source, and that key's name."""
    out = df
    got, how = [], []
    for i, (name, left, right) in enumerate(keys):
        index = unique_index(source, right, value).withColumnsRenamed({"key": f"__k{i}", "value": f"__v{i}"})
        out = out.join(index, left == F.col(f"__k{i}"), "left")
        got.append(F.col(f"__v{i}"))
        how.append(F.when(F.col(f"__v{i}").isNotNull(), F.lit(name)))
    temps = [f"__{c}{i}" for i in range(len(keys)) for c in "kv"]
    return out.withColumns({f"found_{value}": F.coalesce(*got), "found_by": F.coalesce(*how)}).drop(*temps)


def filled(left: DataFrame, right: DataFrame, on: list[str], columns: list[str], source: str | None = None) -> DataFrame:
    """left with its missing columns filled from right, which has each key once; values that are there stay.

    With source, a column <name>_from says where a filled value came from, and is null for those that were there.
    """
    r = right.select(*on, *[F.col(c).alias(f"__{c}") for c in columns])
    j = left.join(r, on, "left")
    from_ = {f"{c}_from": F.when(is_missing(F.col(c)) & ~is_missing(F.col(f"__{c}")), F.lit(source)) for c in columns} if source else {}
    return j.withColumns({c: F.coalesce(present(F.col(c)), present(F.col(f"__{c}"))) for c in columns} | from_).drop(*[f"__{c}" for c in columns])


def layered(left: DataFrame, layers: list[tuple[str, DataFrame]], on: list[str], column: str) -> DataFrame:
    """left with the column from the first layer that has it, and the layer's name."""
    out, got, how = left, [present(F.col(column))], [F.when(~is_missing(F.col(column)), F.lit("own"))]
    for i, (name, df) in enumerate(layers):
        one = df.where(~is_missing(F.col(column))).groupBy(*on).agg(F.min(column).alias(f"__{i}"))
        out = out.join(one, on, "left")
        got.append(F.col(f"__{i}"))
        how.append(F.when(F.col(f"__{i}").isNotNull(), F.lit(name)))
    return out.withColumns({column: F.coalesce(*got), "layer": F.coalesce(*how)}).drop(*[f"__{i}" for i in range(len(layers))])


FILLED = ("authors", "doi", "arxiv_id", "pdf_url", "paper_url")
ABSTRACT = ("abstract", "abstract_source_name", "abstract_source_url", "abstract_source_tier", "abstract_fetched_at")


@dataclass
class Merge:
    """outcomes: id, outcome and old_id of each incoming row; rows: the list after the merge; not_in_source: ids of old rows that no incoming row met."""

    outcomes: DataFrame
    rows: DataFrame
    not_in_source: DataFrame


def merge_outcomes(old: DataFrame, new: DataFrame, approved: DataFrame | None = None) -> DataFrame:
    """id, outcome and old_id of each incoming row: added, joined, filled, ambiguous_match, identifier_title_conflict or title_doi_conflict.

    Both sides have id, block, paper_id, doi, paper_url and title. A row matches the old rows of its block by paper id,
    DOI, or an address that one old row has alone; else by title, unless both have DOIs that differ. A title that differs
    needs an approval (old_id, title: the new one). Rows that match no old row are added, except those that share a paper id, a DOI or (with no
    other DOI) a title with an added row before them, by id, which join it. All is decided by equi-joins and counts.
    """

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("id", "block", doi_key(F.col("doi")).alias("doi"), present(F.lower("paper_id")).alias("pid"), url_key(F.col("paper_url")).alias("url"), plain_title_key_col(F.col("title")).alias("tkey"), F.col("title").alias("shown")).distinct()

    o, n = spool(keyed(old), "merge-old"), spool(keyed(new), "merge-new")
    ids = lambda df, cols: df.select("id", "block", F.explode(F.filter(F.array(*[F.concat(F.lit(c + ":"), c) for c in cols]), lambda x: x.isNotNull())).alias("key")).distinct()
    alone = o.where("url IS NOT NULL").groupBy("block", "url").agg(F.min("id").alias("id"), F.count("*").alias("k")).where("k = 1").select("id", "block", F.concat(F.lit("url:"), F.col("url")).alias("key"))
    targets = ids(o, ("pid", "doi")).unionAll(alone).withColumnRenamed("id", "old_id")
    by_id = ids(n, ("pid", "doi", "url")).withColumnRenamed("id", "new_id").join(targets, ["block", "key"]).select("new_id", "old_id").distinct().withColumn("by", F.lit(0))
    t = n.select(F.col("id").alias("new_id"), "block", "tkey", F.col("doi").alias("nd")).where("tkey <> ''").join(o.select(F.col("id").alias("old_id"), "block", "tkey", F.col("doi").alias("od")), ["block", "tkey"])
    by_title = t.where("nd IS NULL OR od IS NULL OR nd = od").select("new_id", "old_id").distinct().withColumn("by", F.lit(1))
    hits = by_id.unionAll(by_title)
    best = hits.groupBy("new_id").agg(F.min("by").alias("by"))
    hits = spool(hits.join(best, ["new_id", "by"]).groupBy("new_id", "by").agg(F.count("*").alias("hits_n"), F.min("old_id").alias("old_id")), "merge-hits")
    # rows that match none, joined with each other
    fresh = n.join(hits.select(F.col("new_id").alias("id")), "id", "left_anti")
    doiless = fresh.where("tkey <> ''").groupBy("block", "tkey").agg(F.min("doi").alias("lo"), F.max("doi").alias("hi")).where("lo IS NULL OR lo = hi").select("block", "tkey")
    titled = fresh.join(doiless, ["block", "tkey"], "left_semi").select("id", "block", F.concat(F.lit("t:"), F.col("tkey")).alias("key"))
    shared = ids(fresh, ("pid", "doi")).unionAll(titled)
    anchor = shared.groupBy("block", "key").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1")
    edges = shared.join(anchor, ["block", "key"]).where("id <> a").select("a", F.col("id").alias("b"))
    first = connected_components(edges).where("node <> component").select(F.col("node").alias("id"), F.col("component").alias("joins"))
    ok = F.lit(False)
    j = n.alias("n").join(hits, F.col("n.id") == F.col("new_id"), "left").join(o.alias("o"), F.col("old_id") == F.col("o.id"), "left").join(first.alias("f"), F.col("n.id") == F.col("f.id"), "left")
    if approved is not None:
        j = j.join(approved.select(F.col("old_id").alias("a_id"), F.col("title").alias("a_title")).distinct(), (F.col("old_id") == F.col("a_id")) & (F.col("n.shown") == F.col("a_title")), "left")
        ok = F.col("a_id").isNotNull()
    outcome = (
        F.when(F.col("old_id").isNull(), F.when(F.col("joins").isNull(), "added").otherwise("joined"))
        .when(F.col("hits_n") > 1, "ambiguous_match")
        .when((F.col("by") == 0) & (F.col("n.tkey") != F.col("o.tkey")) & ~ok, "identifier_title_conflict")
        .when(F.col("n.doi").isNotNull() & F.col("o.doi").isNotNull() & (F.col("n.doi") != F.col("o.doi")), "title_doi_conflict")
        .otherwise("filled")
    )
    return j.select(F.col("n.id").alias("id"), outcome.alias("outcome"), F.when(F.col("hits_n") == 1, F.col("old_id")).otherwise(F.col("joins")).alias("old_id"))


def merge_incoming(old: DataFrame, new: DataFrame, approved: DataFrame | None = None) -> Merge:
    """Incoming rows merged into the lists they belong to, block by block. See merge_outcomes for how rows match.

    Both sides have id, block, paper_id, title, list_status and the columns of FILLED and ABSTRACT. Blank fields are filled
    from the first incoming row, by id, that has them, an abstract with what is known of its source; fields that are there stay,
    but for an approved title. Rows with a conflict change nothing. A new row whose paper id is taken gets another; a list
    keeps its status. Repeated rows count once; null blocks, ids and empty tables give nothing.
    """
    out = spool(merge_outcomes(old, new, approved), "merge-outcomes")
    kept = ["id", "block", "paper_id", "title", "list_status", *FILLED, *ABSTRACT]
    source = new.select(*kept).dropDuplicates(["id"]).join(out.where("outcome IN ('filled', 'joined')").select("id", F.col("old_id").alias("into")), "id")
    first = lambda c, has: F.min_by(c, F.when(has, F.col("id")))
    given = source.groupBy("into").agg(
        *[first(present(F.col(c)), ~is_missing(F.col(c))).alias(f"__{c}") for c in FILLED],
        first(F.struct(*ABSTRACT), ~is_missing(F.col("abstract"))).alias("__abstract"),
    )
    added = new.select(*kept).dropDuplicates(["id"]).join(out.where("outcome = 'added'").select("id"), "id", "left_semi")
    taken = old.select("block", F.lower("paper_id").alias("__p")).distinct().withColumn("__taken", F.lit(True))
    status = old.groupBy("block").agg(F.min("list_status").alias("__status")).unionAll(added.join(old.select("block").distinct(), "block", "left_anti").groupBy("block").agg(F.min_by("list_status", "id").alias("__status")))
    added = added.withColumn("__p", F.lower("paper_id")).join(taken, ["block", "__p"], "left").withColumn("paper_id", F.when(F.col("__taken"), F.concat(F.lit("published-"), F.col("paper_id"))).otherwise(F.col("paper_id"))).select(*kept)
    rows = old.select(*kept).dropDuplicates(["id"]).unionByName(added)
    if approved is not None:
        renamed = approved.join(new.join(out.where("outcome = 'filled'").withColumnRenamed("old_id", "into"), "id").select(F.col("into").alias("old_id"), "title"), ["old_id", "title"], "left_semi").groupBy("old_id").agg(F.min("title").alias("__title"))
        rows = rows.join(renamed.withColumnRenamed("old_id", "id"), "id", "left").withColumn("title", F.coalesce("__title", "title")).drop("__title")
    j = rows.join(given.withColumnRenamed("into", "id"), "id", "left").join(status, "block", "left")
    bare = is_missing(F.col("abstract")) & F.col("__abstract").isNotNull()
    rows = j.select("id", "block", "paper_id", "title", F.coalesce("__status", "list_status", F.lit("rolling")).alias("list_status"), *[F.when(is_missing(F.col(c)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in FILLED], *[F.when(bare, F.col(f"__abstract.{c}")).otherwise(F.col(c)).alias(c) for c in ABSTRACT])
    unmet = old.select("id").distinct().join(out.where("outcome = 'filled'").select(F.col("old_id").alias("id")), "id", "left_anti")
    return Merge(out, rows, unmet)


def dispositions(reference: DataFrame, local: DataFrame, within: list[str]) -> DataFrame:
    """ref_id, disposition (matched, ambiguous, existing_elsewhere or missing_candidate) and local_id, null unless matched.

    Rows match by DOI or address anywhere, else by title anywhere; what counts is how many of these partners are of the
    reference's own group. Both sides have id, title, doi, paper_url, pdf_url and the columns of within.
    """

    def keys(df: DataFrame) -> DataFrame:
        k = F.array(F.concat(F.lit("doi:"), doi_key(F.col("doi"))), F.concat(F.lit("url:"), url_key(F.col("paper_url"))), F.concat(F.lit("url:"), url_key(F.col("pdf_url"))))
        return df.select("id", F.struct(*within).alias("g"), F.explode(F.filter(k, lambda x: x.isNotNull())).alias("key")).distinct()

    t = lambda df: df.select("id", F.struct(*within).alias("g"), plain_title_key_col(F.col("title")).alias("key")).where("key <> ''").distinct()
    meet = lambda a, b: a.select(F.col("id").alias("ref_id"), F.col("g").alias("rg"), "key").join(b.select(F.col("id").alias("local_id"), F.col("g").alias("lg"), "key"), "key").select("ref_id", "local_id", (F.col("rg") == F.col("lg")).alias("inside")).distinct()
    by_id = meet(keys(reference), keys(local))
    no_id = t(reference).join(by_id.select(F.col("ref_id").alias("id")).distinct(), "id", "left_anti")
    g = by_id.unionAll(meet(no_id, t(local))).groupBy("ref_id").agg(F.count_if("inside").alias("n_inside"), F.min(F.when(F.col("inside"), F.col("local_id"))).alias("one"))
    j = reference.select(F.col("id").alias("ref_id")).distinct().join(g, "ref_id", "left")
    d = F.when(F.col("n_inside") == 1, "matched").when(F.col("n_inside") > 1, "ambiguous").when(F.col("n_inside").isNotNull(), "existing_elsewhere").otherwise("missing_candidate")
    return j.select("ref_id", d.alias("disposition"), F.when(F.col("n_inside") == 1, F.col("one")).alias("local_id"))


def doi_difference(local: DataFrame, foreign: DataFrame, within: list[str]) -> DataFrame:
    """The groups' columns, doi, side (foreign_only or local_only) and elsewhere: whether the other side has the DOI in another group.

    Both sides have doi and the columns of within. DOIs count once per group; missing ones do not count.
    """
    k = lambda df: df.select(*within, doi_key(F.col("doi")).alias("doi")).where("doi IS NOT NULL").distinct()
    a, b = k(local), k(foreign)
    on = [*within, "doi"]
    known = lambda df: df.select("doi").distinct().withColumn("__there", F.lit(True))
    side = lambda x, y, name: x.join(y, on, "left_anti").join(known(y), "doi", "left").select(*within, "doi", F.lit(name).alias("side"), F.coalesce("__there", F.lit(False)).alias("elsewhere"))
    return side(b, a, "foreign_only").unionAll(side(a, b, "local_only"))


def collapsed(rows: DataFrame, key: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, conflicts): each identity once; identities whose rows differ in a column of same are conflicts, with the number of values of each."""
    g = rows.groupBy(*key).agg(*[F.min(c).alias(c) for c in rows.columns if c not in key], *[F.countDistinct(F.coalesce(c, F.lit(""))).alias(f"n_{c}") for c in same])
    bad = any_of([F.col(f"n_{c}") > 1 for c in same])
    return g.where(~bad).select(*rows.columns), g.where(bad).select(*key, *[f"n_{c}" for c in same])


#: Numbers that letters are told apart by, modulo this, and how many of one letter are counted one by one.
_LETTERS, _LEVELS = 32, 10
_PROFILE = T.StructField("letters", T.StructType([T.StructField("size", T.IntegerType()), T.StructField("more", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType()))]))


def _profiles(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """size, more and bits of each title in lower case: its length, the letters not in the bits, and a bit for the first, second, ... time of each letter.

    Two titles have at most as many letters in common as they have common bits, and the smaller of their more.
    """
    low = [t.lower() for t in titles]
    size = np.fromiter(map(len, low), np.int64, len(low))
    flat = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32) % _LETTERS
    counts = np.bincount(np.repeat(np.arange(len(low)), size) * _LETTERS + flat, minlength=len(low) * _LETTERS).reshape(-1, _LETTERS)
    bits = np.packbits(counts[:, :, None] > np.arange(_LEVELS), axis=None).view(np.int64).reshape(len(low), -1)
    return size, np.maximum(counts - _LEVELS, 0).sum(1), bits


def _with_profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and title with the title's letters, of batches of block and title."""
    for batch in batches:
        if batch.num_rows:
            size, more, bits = _profiles(batch.column("title").to_pylist())
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
            letters = pa.StructArray.from_arrays([pa.array(size.astype(np.int32)), pa.array(more.astype(np.int32)), each], ["size", "more", "bits"])
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("title"), letters], names=["block", "title", "letters"])


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence; the matching blocks of a and b have no more letters."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def title_ratio(least: float):
    """A function of two columns: the matching-blocks ratio of two titles in lower case, null below least."""

    def ratio(a: str, b: str) -> float | None:
        if a and b and 2.0 * _common(a, b) / (len(a) + len(b)) < least:
            return None
        r = SequenceMatcher(None, a, b).ratio()
        return r if r >= least else None

    @F.pandas_udf(T.DoubleType())
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio((x or "").lower(), (y or "").lower()) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratios


#: Titles of a side that are held against as many of the other in one step, and how many of them at once.
_PACK, _TILE = 4096, 32


def _packs(df: DataFrame, block: str, name: str) -> DataFrame:
    """block, the titles of a pack with their letters, and their least and greatest size; a block's packs follow each other by size. Missing titles have none."""
    titles = df.select(F.col(block).alias("block"), "title").where(F.col("block").isNotNull() & ~is_missing(F.col("title"))).distinct()
    titles = titles.mapInArrow(_with_profile, T.StructType([*titles.schema.fields, _PROFILE]))
    # ordered by the title too, so that a task that runs again makes the same packs
    packs = titles.withColumn("pack", F.floor((F.row_number().over(Window.partitionBy("block").orderBy("letters.size", "title")) - 1) / _PACK))
    return packs.groupBy("block", "pack").agg(F.collect_list(F.struct("title", "letters.*")).alias(name), F.min("letters.size").alias(f"{name}_low"), F.max("letters.size").alias(f"{name}_high")).drop("pack")


def _by_size(pack: pa.StructArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Title, size, more and bits of a pack's titles in the order of their size."""
    size = pack.field("size").to_numpy()
    at = np.argsort(size, kind="stable")
    bits = pack.field("bits").flatten().to_numpy().reshape(len(size), -1).view(np.uint64)
    return pack.field("title").take(pa.array(at)), size[at], pack.field("more").to_numpy()[at], bits[at]


def _near(least: float):
    """A function of batches of block and two packs: block, id_title and other_title of all pairs with so many letters in common that they may reach least."""

    def pairs(id_pack: pa.StructArray, other_pack: pa.StructArray) -> tuple[pa.Array, pa.Array]:
        titles, size, more, bits = _by_size(id_pack)
        o_titles, o_size, o_more, o_bits = _by_size(other_pack)
        words = np.ascontiguousarray(o_bits.T)
        # rounded down on both sides, so that the sum asks for no more letters than the ratio does
        need, o_need = (np.floor(least * n / 2 - 1e-6).astype(np.int32) for n in (size, o_size))
        x, y = [], []
        for i in range(0, len(size), _TILE):
            t = slice(i, i + _TILE)
            nearest = np.clip(o_size, size[t][0], size[t][-1])
            fit = np.flatnonzero(2.0 * np.minimum(o_size, nearest) / (o_size + nearest) >= least)
            if not len(fit):
                continue
            o = slice(fit[0], fit[-1] + 1)
            spare = np.minimum(more[t, None], o_more[None, o]) - need[t, None] - o_need[None, o]
            for w, word in enumerate(words):
                spare += np.bitwise_count(bits[t, w, None] & word[None, o])
            at, o_at = np.nonzero(spare >= 0)
            x.append(at + i)
            y.append(o_at + o.start)
        none = [np.empty(0, np.int64)]
        return titles.take(pa.array(np.concatenate(x or none))), o_titles.take(pa.array(np.concatenate(y or none)))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b in zip(*map(batch.column, ("block", "id", "other")), strict=True):
                left, right = pairs(a.values, b.values)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.repeat(block, len(left)), left, right], names=["block", "id_title", "other_title"])

    return met


def fuzzy_titles(left: DataFrame, right: DataFrame, block: str, least: float = 0.45, best: int = 5, worded: bool = True) -> DataFrame:
    """id, other, ratio and place of the best partners by title within a block.

    Both sides have id, title and the block. Each title counts once in a block, whatever the number of its rows, and only pairs with so
    many letters in common that they may reach the ratio go on to it. Without worded these are of all pairs of titles in a block that are not
    missing, so no partner is left out; pairs are met in the square of the titles of a block. With worded, for low ratios, partners share one of
    their three longest words of six letters or more: these are join keys, and the others are left out.
    """
    rows = lambda df, name: df.select(F.col("id").alias(name), F.col(block).alias("block"), F.col("title").alias(f"{name}_title")).distinct()

    def words(df: DataFrame, name: str) -> DataFrame:
        w = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}]+"), lambda x: F.length(x) >= 6))
        longest = F.slice(F.sort_array(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("word")))), 1, 3)
        titles = df.select(F.col(block).alias("block"), "title").where("block IS NOT NULL AND title IS NOT NULL").distinct()
        titles = titles.mapInArrow(_with_profile, T.StructType([*titles.schema.fields, _PROFILE]))
        bits = [F.col("letters.bits")[i].alias(f"{name}_{i}") for i in range(_LETTERS * _LEVELS // 64)]
        return titles.select("block", F.col("title").alias(f"{name}_title"), F.col("letters.size").alias(f"{name}_size"), F.col("letters.more").alias(f"{name}_more"), *bits, F.explode(longest.getField("word")).alias("word"))

    # few bytes and much work, so by number
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if worded:
        common = F.least("id_more", "other_more")
        for i in range(_LETTERS * _LEVELS // 64):
            common = common + F.bit_count(F.col(f"id_{i}").bitwiseAND(F.col(f"other_{i}")))
        near = 2.0 * common / (F.col("id_size") + F.col("other_size")) >= least
        met = words(left, "id").join(words(right, "other"), ["block", "word"]).where(near).select("block", "id_title", "other_title")
    else:
        a, b = _packs(left, block, "id"), _packs(right, block, "other")
        low, high = F.least("id_high", "other_high"), F.greatest("id_low", "other_low")  # the sizes that are nearest, unless some are equal
        met = a.join(b, "block").where((high <= low) | (2.0 * low / (low + high) >= least)).select("block", "id", "other").repartition(tasks)
        met = met.mapInArrow(_near(least), T.StructType([met.schema["block"], *[T.StructField(c, T.StringType()) for c in ("id_title", "other_title")]]))
    pairs = met.repartition(tasks, "block", "id_title", "other_title").distinct()
    scored = pairs.withColumn("ratio", title_ratio(least)("id_title", "other_title")).where("ratio IS NOT NULL")
    # of the rows of one title the first can be among the best only, and of a title's partners likewise
    others = rows(right, "other").withColumn("n", F.row_number().over(Window.partitionBy("block", "other_title").orderBy("other"))).where(F.col("n") <= best).drop("n")
    by_title = scored.join(others, ["block", "other_title"]).withColumn("n", F.row_number().over(Window.partitionBy("block", "id_title").orderBy(F.desc("ratio"), "other"))).where(F.col("n") <= best).drop("n")
    ranked = by_title.join(rows(left, "id"), ["block", "id_title"]).select("id", "other", "id_title", "other_title", "ratio").distinct()
    w = Window.partitionBy("id").orderBy(F.desc("ratio"), "other")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= best).select("id", "other", F.round("ratio", 6).alias("ratio"), "place")


def name_tokens(c: Column) -> Column:
    """The words of a name in lower case, sorted."""
    return F.array_sort(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), F.lit(1)))


def is_author(presenter: Column, authors: Column) -> Column:
    """Whether one of the authors, separated by semicolons, has the words of the presenter."""
    return F.exists(F.split(authors, ";"), lambda a: name_tokens(a) == name_tokens(presenter))


def accepted(title_agrees: Column, author_agrees: Column, year_agrees: Column, doi_agrees: Column) -> Column:
    """The gate for foreign metadata: the DOI agrees, or the title with an author or the year."""
    return F.coalesce(doi_agrees, F.lit(False)) | (F.coalesce(title_agrees, F.lit(False)) & any_of([F.coalesce(author_agrees, F.lit(False)), F.coalesce(year_agrees, F.lit(False))]))


def byline_begins(authors: Column, other: Column) -> Column:
    """Whether the first author of one list begins the other."""
    first = lambda c: F.array_join(name_tokens(F.split(c, ";")[0]), " ")
    return (first(authors) != "") & (first(authors) == first(other))


def gates(pairs: DataFrame) -> DataFrame:
    """pairs with the gate that lets a foreign row through: the first of these that holds, or null.

    pairs: two sides as columns l_ and r_ of id, title, authors, year, kind, doi, venue, published (ISO date) and forum
    (a review forum's id), and cutoff. id_title: id and title agree; doi: DOIs agree, the venue too, and it is not after the cutoff;
    title_author: title, first author, kind and year agree; forum: one forum id and one title; title_year: title and year, if one
    candidate only has the title.
    """
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    both = lambda a, b: (a != "") & (a == b)
    title = both(key(F.col("l_title")), key(F.col("r_title")))
    year = F.coalesce(F.col("l_year") == F.col("r_year"), F.lit(False))
    doi = F.coalesce(doi_key(F.col("l_doi")) == doi_key(F.col("r_doi")), F.lit(False))
    in_time = F.coalesce(F.col("r_published") <= F.col("cutoff"), F.lit(True))
    one = F.count(F.when(title, 1)).over(Window.partitionBy("l_id")) == 1
    gate = (
        F.when(F.coalesce(F.col("l_id") == F.col("r_id"), F.lit(False)) & title, "id_title")
        .when(doi & both(key(F.col("l_venue")), key(F.col("r_venue"))) & in_time, "doi")
        .when(title & byline_begins(F.col("l_authors"), F.col("r_authors")) & F.coalesce(F.col("l_kind") == F.col("r_kind"), F.lit(False)) & year, "title_author")
        .when(F.coalesce(F.col("l_forum") == F.col("r_forum"), F.lit(False)) & title, "forum")
        .when(title & year & one, "title_year")
    )
    return pairs.withColumn("gate", gate)


def candidate_matches(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """item_id, other_id and how (doi, arxiv or title): each candidate under the first key that agrees; a title counts with an author's words or the year.

    Both sides have id, doi, arxiv_id, title, authors and year. Three equi-joins, no comparison of all with all.
    """

    def k(df: DataFrame) -> DataFrame:
        return df.select("id", doi_key(F.col("doi")).alias("doi"), F.when(~is_missing(F.col("arxiv_id")), F.regexp_replace(F.regexp_replace(F.lower(F.trim("arxiv_id")), r"^arxiv:\s*", ""), r"v\d+$", "")).alias("arxiv"), F.nullif(plain_title_key_col(F.col("title")), F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), "year")

    a, b = k(items), k(candidates)
    parts = []
    for i, how in enumerate(("doi", "arxiv", "title")):
        j = a.alias("a").join(b.alias("b"), F.col(f"a.{how}") == F.col(f"b.{how}"))
        if how == "title":
            known = lambda s: F.transform(F.split(F.col(f"{s}.authors"), ";"), lambda n: F.array_join(name_tokens(n), " "))
            named = F.arrays_overlap(F.filter(known("a"), lambda n: n != ""), F.filter(known("b"), lambda n: n != ""))
            j = j.where(F.coalesce(named, F.lit(False)) | (F.col("a.year") == F.col("b.year")))
        parts.append(j.select(F.col("a.id").alias("item_id"), F.col("b.id").alias("other_id"), F.lit(i).alias("o"), F.lit(how).alias("how")))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("item_id", "other_id").agg(F.min_by("how", "o").alias("how"))
