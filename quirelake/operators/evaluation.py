"""Metrics of labels, agreement of labellings, and stratified samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from quirelake.functions.columns import wilson


def class_metrics(pairs: DataFrame, gold: str, pred: str, least: int = 2) -> DataFrame:
    """Of each class its gold and predicted counts, precision, recall and F1; counted says whether it enters the macro mean."""
    c = pairs.select(F.col(gold).alias("g"), F.col(pred).alias("p"))
    g = c.groupBy(F.col("g").alias("label")).agg(F.count("*").alias("n_gold"), F.count_if(F.col("g") == F.col("p")).alias("hits"))
    p = c.where("p IS NOT NULL").groupBy(F.col("p").alias("label")).agg(F.count("*").alias("n_pred"))
    j = g.join(p, "label", "full").select("label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_gold", "n_pred", "hits")])
    f1 = F.when(F.col("n_gold") + F.col("n_pred") > 0, 2.0 * F.col("hits") / (F.col("n_gold") + F.col("n_pred"))).otherwise(0.0)
    return j.select("label", "n_gold", "n_pred", F.when(F.col("n_pred") > 0, F.col("hits") / F.col("n_pred")).alias("precision"), F.when(F.col("n_gold") > 0, F.col("hits") / F.col("n_gold")).alias("recall"), f1.alias("f1"), (F.col("n_gold") >= least).alias("counted"))


def overall_metrics(pairs: DataFrame, gold: str, pred: str) -> DataFrame:
    """n, correct, accuracy with its 95 % interval."""
    o = pairs.agg(F.count("*").alias("n"), F.count_if(F.col(gold) == F.col(pred)).alias("correct"))
    lo, hi = wilson(F.col("correct"), F.col("n"))
    return o.select("n", "correct", F.when(F.col("n") > 0, F.round(F.col("correct") / F.col("n"), 4)).alias("accuracy"), lo.alias("low"), hi.alias("high"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labellings, from counts per label."""
    c = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    total = c.agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("agree"))
    chance = c.groupBy(F.col("x").alias("l")).agg(F.count("*").alias("nx")).join(c.groupBy(F.col("y").alias("l")).agg(F.count("*").alias("ny")), "l").agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("both"))
    pe = F.col("both") / (F.col("n") * F.col("n"))
    po = F.col("agree") / F.col("n")
    return total.join(chance).select("n", "agree", F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two groupings, from their contingency counts."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    s = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("t"))
    sa = cells.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sa"))
    sb = cells.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sb"))
    mean = F.col("sa") * F.col("sb") / two("t")
    top = (F.col("sa") + F.col("sb")) / 2
    return s.join(sa).join(sb).select(F.when(top != mean, F.round((F.col("s") - mean) / (top - mean), 6)).otherwise(1.0).alias("ari"))


def majority(votes: DataFrame, item: str, group: str) -> DataFrame:
    """The group most rows of an item have; of several the smallest."""
    n = votes.groupBy(item, group).agg(F.count("*").alias("n"))
    return n.groupBy(item).agg(F.max("n").alias("n_most"), F.min_by(group, F.struct(-F.col("n"), F.col(group))).alias(group))


def precision_table(samples: DataFrame) -> DataFrame:
    """Per topic and band, per topic, per band and overall: verdict counts, and the precision among the decided with its interval."""
    decided = F.col("relevant") + F.col("mention_only") + F.col("wrong_signal")
    g = samples.groupingSets([["topic_id", "band"], ["topic_id"], ["band"], []], "topic_id", "band").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("relevant", "mention_only", "wrong_signal", "uncertain")])
    lo, hi = wilson(F.col("relevant"), decided)
    return g.select("topic_id", "band", "relevant", "mention_only", "wrong_signal", "uncertain", F.when(decided > 0, F.bround(100.0 * F.col("relevant") / decided, 1)).alias("precision"), lo.alias("low"), hi.alias("high"))


def score_band(score):
    return F.when(score >= 6, "high").when(score > 3, "middle").otherwise("boundary")


def sampled(rows: DataFrame, strata: list[str], key: str, quota: int, seed: str) -> DataFrame:
    """quota rows of each stratum in the order of a hash of seed and key; the same rows at every run."""
    order = F.sha2(F.concat(F.lit(seed), F.chr(F.lit(0)), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("sample_order", F.row_number().over(w)).where(F.col("sample_order") <= quota)


def round_robin(rows: DataFrame, strata: list[str], turn: str, key: str, quota: int, seed: str) -> DataFrame:
    """quota rows of each stratum, taken from the values of turn in turn, each in the order of a hash, last first."""
    h = F.sha2(F.concat(F.lit(seed), F.chr(F.lit(0)), F.col(key).cast("string")), 256)
    first = F.row_number().over(Window.partitionBy(*strata, turn).orderBy(F.desc(h)))
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy("round", turn))
    return rows.withColumn("round", first).withColumn("nth", nth).where(F.col("nth") <= quota).drop("round")


def allocate(counts: dict[str, int], n: int, minimum: int = 1) -> dict[str, int]:
    """n places divided over groups in proportion to their size, each with at least minimum.

    A group gets the whole part of its share. Places that are left go one by one, again and again, to the groups in the
    order of the fractions cut off, largest first, as far as they have rows; places too many are taken in the opposite
    order from groups above the minimum. If neither can be done further, fewer or more than n are given.
    """
    whole = sum(counts.values())
    if not whole:
        return dict.fromkeys(counts, minimum)
    share = {g: n * c / whole for g, c in counts.items()}
    cut = {g: x - math.floor(x) for g, x in share.items()}
    out = {g: max(minimum, math.floor(x)) for g, x in share.items()}
    while (short := n - sum(out.values())) != 0:
        if short > 0:
            may = [g for g in sorted(counts, key=lambda g: (-cut[g], g)) if out[g] < counts[g]]
        else:
            may = [g for g in sorted(counts, key=lambda g: (cut[g], g)) if out[g] > minimum]
        if not may:
            break
        for g in may[: abs(short)]:
            out[g] += 1 if short > 0 else -1
    return out


def averages(metrics: DataFrame) -> DataFrame:
    """Macro averages over the counted classes of class_metrics, micro averages over all."""
    at = lambda c: F.when(F.col("counted"), F.coalesce(c, F.lit(0.0)))
    r = lambda c, name: F.round(c, 4).alias(name)
    hits = F.round(F.coalesce("recall", F.lit(0.0)) * F.col("n_gold"))
    return metrics.agg(
        r(F.avg(at("precision")), "macro_precision"),
        r(F.avg(at("recall")), "macro_recall"),
        r(F.avg(at("f1")), "macro_f1"),
        r(F.sum(hits) / F.sum("n_pred"), "micro_precision"),
        r(F.sum(hits) / F.sum("n_gold"), "micro_recall"),
        F.count_if("counted").alias("n_classes"),
    )


def confusions(pairs: DataFrame, gold: str, pred: str, key: str, most: int = 10, examples: int = 3) -> DataFrame:
    """gold, pred, n and the first examples of the most frequent confusions; examples are the smallest keys, kept by number, not collected."""
    c = pairs.where(F.col(gold) != F.col(pred)).select(F.col(gold).alias("gold"), F.col(pred).alias("pred"), F.col(key).alias("key"))
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("gold", "pred").orderBy("key"))).where(F.col("k") <= examples)
    shown = first.groupBy("gold", "pred").agg(F.array_sort(F.collect_list("key")).alias("examples"))
    n = c.groupBy("gold", "pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(most)
    return n.join(shown, ["gold", "pred"])


def soft_agreement(pairs: DataFrame, a: str, b: str, also) -> DataFrame:
    """How often two labellings agree, strictly and where also holds."""
    same = F.col(a) == F.col(b)
    return pairs.agg(F.count("*").alias("n"), F.count_if(same).alias("strict_agree"), F.count_if(same | also).alias("soft_agree")).withColumn("soft_rate", F.round(F.col("soft_agree") / F.col("n"), 4))


def reviewed_samples(samples: DataFrame, reviews: DataFrame, topics: DataFrame) -> DataFrame:
    """samples (sample_id, topic_id, score) with the verdict and error type of their reviews; pending without one. Samples of unknown topics are left out; repeated samples count once."""
    known = samples.dropDuplicates(["sample_id"]).join(topics.select("topic_id"), "topic_id", "left_semi")
    r = reviews.groupBy("sample_id").agg(F.max("verdict").alias("verdict"), F.max("error_type").alias("error_type"))
    return known.join(r, "sample_id", "left").select("sample_id", "topic_id", "score", F.coalesce("verdict", F.lit("pending")).alias("verdict"), F.coalesce("error_type", F.lit("")).alias("error_type"))


def error_groups(samples: DataFrame) -> DataFrame:
    return samples.where("error_type <> ''").groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type")


def sample_page(samples: DataFrame, page: int, size: int) -> DataFrame:
    """A page of samples, wrong ones first."""
    order = F.when(F.col("verdict") == "wrong_signal", 0).when(F.col("verdict") == "mention_only", 1).when(F.col("verdict") == "uncertain", 2).when(F.col("verdict") == "relevant", 3).otherwise(4)
    size = max(1, min(100, size))
    return samples.select("sample_id", "topic_id", "band", "verdict", "score").orderBy(order, "topic_id", "band", F.desc("score"), "sample_id").offset((max(1, page) - 1) * size).limit(size)


def gold_merged(sample: DataFrame, guesses: DataFrame, reviews: DataFrame) -> DataFrame:
    """The gold label of each sampled paper, with the system's and the prelabelled one and whose it agrees with.

    sample: entity_id, sample_order, area_id, direction_id; guesses: entity_id, pred_area, pred_direction; reviews:
    entity_id, area, direction. Refused if a sampled paper has no review or a review no sample.
    """
    lost = sample.join(reviews, "entity_id", "left_anti").select("entity_id").unionAll(reviews.join(sample, "entity_id", "left_anti").select("entity_id"))
    if not lost.isEmpty():
        raise ValueError("reviews and sample do not have the same papers")
    j = sample.join(reviews, "entity_id").join(guesses, "entity_id", "left")
    same = lambda a, d: F.coalesce((F.col("area") == F.col(a)) & (F.col("direction") == F.col(d)), F.lit(False))
    verdict = F.when(same("area_id", "direction_id"), "agree_system").when(same("pred_area", "pred_direction"), "agree_prelabel").otherwise("changed")
    return j.select("entity_id", "sample_order", F.col("area_id").alias("system_area"), F.col("direction_id").alias("system_direction"), "pred_area", "pred_direction", F.col("area").alias("gold_area"), F.col("direction").alias("gold_direction"), verdict.alias("verdict")).orderBy("sample_order", "entity_id")


def to_label(papers: DataFrame, areas_done: DataFrame, directions_done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(without_area, without_direction): what the two stages of prelabelling have still to do; the second works inside the first's area. areas_done: entity_id, area_id."""
    first = papers.join(areas_done.select("entity_id"), "entity_id", "left_anti")
    second = papers.join(areas_done.select("entity_id", "area_id"), "entity_id").join(directions_done.select("entity_id"), "entity_id", "left_anti")
    return first, second


def translation_cost(rows: DataFrame, chars_per_token: float, price_per_million: float) -> DataFrame:
    """Characters of titles and abstracts and the price of their tokens."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("title_chars"), F.sum(F.length("abstract")).alias("abstract_chars"), F.round(F.sum(n("title") + n("abstract")) / chars_per_token / 1_000_000 * price_per_million, 6).alias("cost"))
