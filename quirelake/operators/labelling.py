"""Label files: validation of rows, checks across files, keyword groups and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quirelake.functions.missing import is_missing


def row_errors(rows: DataFrame, enums: dict[str, tuple[str, ...]], required: tuple[str, ...], lists: dict[str, int], key: str) -> DataFrame:
    """key, field and error of each rule a label row breaks: missing fields, values outside their set, lists ('|' between) too long."""
    rules = [F.when(is_missing(F.col(c)), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("error"))) for c in required]
    rules += [F.when(~is_missing(F.col(c)) & ~F.col(c).isin(*values), F.struct(F.lit(c).alias("field"), F.lit("unknown value").alias("error"))) for c, values in enums.items()]
    rules += [F.when(F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x) != "")) > most, F.struct(F.lit(c).alias("field"), F.lit("too many").alias("error"))) for c, most in lists.items()]
    return rows.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("e")).select(key, "e.field", "e.error")


def label_checks(labels: DataFrame, entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """rule and n: how many entities break each rule that labels must meet together. All are counts, none a list."""
    ids = labels.where("entity_id IS NOT NULL").select("entity_id", "area_id", "area_secondary", "is_non_paper")
    known = entities.select("entity_id").distinct()
    areas = definitions.select("area_id").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    parts = [
        count(ids.select("entity_id").distinct().join(known, "entity_id", "left_anti"), "unknown_entity"),
        count(ids.where("area_id IS NOT NULL").join(areas, "area_id", "left_anti").select("entity_id").distinct(), "unknown_area"),
        count(ids.groupBy("entity_id").agg(F.countDistinct("area_id").alias("k")).where("k > 1"), "several_areas"),
        count(ids.where("area_secondary = area_id").select("entity_id").distinct(), "second_equals_first"),
        count(ids.where("is_non_paper = 1 AND coalesce(area_id, '') <> 'other'").select("entity_id").distinct(), "non_paper_with_area"),
        count(known.join(ids.select("entity_id"), "entity_id", "left_anti"), "unlabelled_entity"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def overridden(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """The base rows, each replaced by the override's row of its key; override rows of other keys are left out."""
    o = override.select(key, F.struct(*[c for c in base.columns if c != key]).alias("__o"))
    b = base.select(key, F.struct(*[c for c in base.columns if c != key]).alias("__b"))
    return b.join(o, key, "left").select(key, F.coalesce("__o", "__b").alias("r")).select(key, "r.*").select(*base.columns)


def first_group(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The name of the first rule whose pattern the text has."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, joined by '+'; null if none does."""
    return F.nullif(F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in rules]), F.lit(""))


def vocabulary(rows: DataFrame, term: str, group: str) -> DataFrame:
    """Each term with its count, whether it occurs once only, and its counts by group as a map."""
    g = rows.where(F.col(term).isNotNull()).groupBy(term, group).agg(F.count("*").alias("n"))
    return g.groupBy(term).agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(group, F.lit("")).alias("g"), "n")))).alias("by_group")).withColumn("once", F.col("n") == 1)


def mixed_files(records: DataFrame) -> DataFrame:
    """source_file, and its numbers of venues and years, of files that hold more than one of either."""
    g = records.groupBy("source_file").agg(F.countDistinct("venue").alias("n_venues"), F.countDistinct("year").alias("n_years"), F.count("*").alias("n"))
    return g.where("n_venues > 1 OR n_years > 1")


def import_checks(labels: DataFrame, entities: DataFrame, directions: DataFrame, areas: tuple[str, ...], non_papers: DataFrame) -> DataFrame:
    """rule and n: how many rows of a label file break each rule it must meet before it is imported; all must be 0.

    labels: entity_id, area, direction_id, confidence; directions: direction_id, area_id; non_papers: entity_id.
    """
    l = labels.select("entity_id", F.coalesce("area", F.lit("")).alias("area"), F.coalesce("direction_id", F.lit("")).alias("direction_id"), "confidence")
    d = directions.select("direction_id", F.col("area_id").alias("of")).distinct()
    n = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    papers = l.join(non_papers.select("entity_id").distinct(), "entity_id", "left_anti")
    others = l.join(non_papers.select("entity_id").distinct(), "entity_id", "left_semi")
    parts = [
        n(l.join(entities.select("entity_id"), "entity_id", "left_anti"), "unknown_entity"),
        n(l.groupBy("entity_id").count().where("count > 1"), "repeated_entity"),
        n(entities.select("entity_id").distinct().join(l, "entity_id", "left_anti"), "unlabelled_entity"),
        n(l.where(~F.col("area").isin(*areas)), "unknown_area"),
        n(l.where("direction_id <> ''").join(d, "direction_id", "left_anti"), "unknown_direction"),
        n(l.join(d, "direction_id").where("area <> of"), "direction_of_another_area"),
        n(others.where("direction_id <> ''"), "non_paper_with_direction"),
        n(others.where("area <> 'other'"), "non_paper_not_other"),
        n(l.where(is_missing(F.col("confidence"))), "blank_confidence"),
        n(papers.where("direction_id = '' AND area <> 'other'"), "missing_direction"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def phrase_errors(rows: DataFrame, lengths: dict[str, tuple[int, int]], confidence: str, key: str, reviewed: Column | None = None) -> DataFrame:
    """key, field and error of phrases with too few or many words, and of low confidence without a review."""
    rules = []
    for c, (least, most) in lengths.items():
        n = F.size(F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
        rules.append(F.when(~n.between(least, most), F.struct(F.lit(c).alias("field"), F.lit("phrase length").alias("error"))))
    low = F.coalesce(F.lower(F.trim(confidence)) == "low", F.lit(False)) & ~(reviewed if reviewed is not None else F.lit(False))
    rules.append(F.when(low, F.struct(F.lit(confidence).alias("field"), F.lit("low without review").alias("error"))))
    return rows.select(key, F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("e")).select(key, "e.field", "e.error")
