"""Writers: releases that appear at once, annual lists, shards, and exports of a collection."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quirelake.sources.readers import LIST_COLUMNS

# BibTeX entry types by type of venue (others are misc), and characters that need an escape.
BIBTEX_TYPES = {"conference": "inproceedings", "journal": "article"}
BIBTEX_ESCAPES = {"&": r"\&", "_": r"\_"}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(root: str, release_id: str, tables: dict[str, DataFrame], gates: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> str:
    """Writes all tables of a release into a folder of its own, checks the gates, then makes the release current.

    A gate gives the rows of its table that break it; any row stops the release, which then never becomes
    current. The current release is named in a small file, a pointer; each release has a pointer with a number of its
    own, which appears by a rename, and the largest number holds.
    """
    spark = next(iter(tables.values())).sparkSession
    at = f"{root}/release={release_id}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{at}/{name}")
    for name, gate in (gates or {}).items():
        broken = gate(spark.read.parquet(f"{at}/{name}")).limit(1).count()  # one broken row is enough
        if broken:
            raise ValueError(f"release {release_id}: {name} breaks its gate")
    pointers, fs = _fs(spark, f"{root}/current")
    n = max(_pointers(fs, pointers), default=-1) + 1
    hidden, _ = _fs(spark, f"{root}/current/_{n:09d}.{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    out.write(json.dumps({"release_id": release_id, "tables": sorted(tables)}).encode())
    out.close()
    shown, _ = _fs(spark, f"{root}/current/{n:09d}.json")
    if not fs.rename(hidden, shown):
        fs.delete(hidden, False)
        raise RuntimeError(f"release {release_id}: another release became current at the same time")
    return at


def _pointers(fs, folder) -> list[int]:
    """The numbers of the pointers there are."""
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def current_release(spark: SparkSession, root: str) -> dict | None:
    """What the pointer with the largest number says; readers see the old or the new release whole, as no pointer is ever replaced."""
    folder, fs = _fs(spark, f"{root}/current")
    numbers = _pointers(fs, folder)
    if not numbers:
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{root}/current/{max(numbers):09d}.json").collect()))


def write_lists(records: DataFrame, path: str) -> None:
    """Annual lists by venue and year, rows in the order of track and paper id."""
    cols = [c for c in LIST_COLUMNS if c not in ("venue", "year")]
    records.select(*cols, "venue", "year").repartition("venue", "year").sortWithinPartitions("venue", "year", "track", "paper_id").write.mode("overwrite").partitionBy("venue", "year").option("header", True).option("escape", '"').csv(path)


def write_gzip_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').csv(path)


def write_shards(df: DataFrame, path: str, order: str, size: int) -> None:
    """JSON lines in shards of so many rows each (the last may have fewer), numbered in the order of a column.

    Rows are numbered without a global window: ranges are sorted apart, counted, and their counts summed.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    tmp = f"{path}.ranges"
    ranged.write.mode("overwrite").parquet(tmp)
    ranged = spark.read.parquet(tmp)
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"))  # one row per range
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("__p")) - F.col("n")).drop("n")
    ranged.join(F.broadcast(before), "__p").withColumn("shard", F.floor((F.col("before") + F.col("__i")) / size)).drop("__p", "__i", "before").repartition("shard").sortWithinPartitions("shard", order).write.mode("overwrite").partitionBy("shard").json(path)
    p, fs = _fs(spark, tmp)
    fs.delete(p, True)


def bibtex_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for plain, escaped in BIBTEX_ESCAPES.items():
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def bibtex_key(entity_id: Column, title: Column) -> Column:
    """Twenty letters and digits of the title, or paper, and the end of the entity's id, which keeps keys apart."""
    word = F.substring(F.regexp_replace(F.coalesce(title, F.lit("")), "[^A-Za-z0-9]+", ""), 1, 20)
    return F.concat(F.when(word == "", "paper").otherwise(word), F.right(entity_id, F.lit(6)))


def bibtex(papers: DataFrame) -> DataFrame:
    """entity_id and entry: a BibTeX entry of each paper. papers: entity_id, title, authors, venue, venue_type, year, doi, paper_url."""
    kind = F.lit("misc")
    for of, name in BIBTEX_TYPES.items():
        kind = F.when(F.col("venue_type") == of, name).otherwise(kind)
    place = F.when(F.col("venue_type") == "journal", "journal").otherwise("booktitle")
    people = F.array_join(F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != ""), " and ")
    fields = [("title", bibtex_escape(F.col("title"))), ("author", bibtex_escape(people)), ("year", F.col("year").cast("string")), ("doi", F.coalesce("doi", F.lit(""))), ("url", F.coalesce("paper_url", F.lit("")))]
    lines = [F.when(v != "", F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields]
    venue = F.concat(F.lit("  "), place, F.lit(" = {"), bibtex_escape(F.col("venue")), F.lit("}"))
    entry = F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(F.col("entity_id"), F.col("title")), F.lit(",\n"), F.concat_ws(",\n", *lines, venue), F.lit("\n}"))
    return papers.select("entity_id", entry.alias("entry"))


def markdown(papers: DataFrame) -> DataFrame:
    """entity_id and entry: a list item of each paper."""
    link = F.when(F.coalesce("paper_url", F.lit("")) != "", F.concat(F.lit("["), F.col("title"), F.lit("]("), F.col("paper_url"), F.lit(")"))).otherwise(F.col("title"))
    return papers.select("entity_id", F.concat(F.lit("- "), link, F.lit(" — "), F.coalesce("authors", F.lit("")), F.lit(" ("), F.col("venue"), F.lit(", "), F.col("year").cast("string"), F.lit(")")).alias("entry"))


def export(papers: DataFrame, path: str, form: str) -> None:
    """The papers of a collection as csv, json, bibtex or markdown."""
    if form == "csv":
        # a byte-order mark before the first column's name, for spreadsheets
        first, *rest = papers.columns
        papers.select(F.col(first).alias("\ufeff" + first), *rest).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif form == "json":
        papers.write.mode("overwrite").json(path)
    elif form in ("bibtex", "markdown"):
        {"bibtex": bibtex, "markdown": markdown}[form](papers).orderBy("entity_id").select("entry").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown form: {form}")
