"""Readers of annual lists, labels, documents and paged services."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The columns of an annual list, in this order.
LIST_COLUMNS = (
    "paper_id", "venue", "venue_type", "year", "track", "title", "authors", "abstract", "abstract_source_name", "abstract_source_url", "abstract_source_tier",
    "abstract_fetched_at", "doi", "arxiv_id", "paper_url", "pdf_url", "source_name", "source_url", "source_tier", "verification_status", "list_status", "fetched_at",
)
LIST_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in LIST_COLUMNS])


def listed(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """The files below a folder of any file system, sorted by path; only their names come to the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return []
    out, it = [], fs.listFiles(p, True)
    while it.hasNext():
        path = it.next().getPath()
        if path.getName().endswith(suffix):
            out.append(path.toString().replace("file:/", "/", 1) if path.toUri().getScheme() == "file" else path.toString())
    return sorted(out)


def list_files(spark: SparkSession, root: str, folders: tuple[str, ...] = ("conferences", "journals")) -> list[str]:
    """The annual lists below the folders, sorted by path."""
    return [p for f in folders for p in listed(spark, f"{root}/{f}", ".csv")]


def check_headers(spark: SparkSession, paths: list[str]) -> None:
    """Refuses lists whose header is not exactly the expected one, or that are empty. Each task reads the beginning of its files; the first bad one is named."""
    whole = spark.read.format("binaryFile").load(paths).select("path", F.decode(F.substring("content", 1, 1 << 16), "UTF-8").alias("head"))
    lines = F.filter(F.split("head", r"\r?\n"), lambda x: F.trim(x) != "")
    bad = whole.select("path", F.regexp_replace(F.get(lines, F.lit(0)), "^\ufeff", "").alias("header"), F.size(lines).alias("n"))
    expected = ",".join(LIST_COLUMNS)
    first = bad.where((F.coalesce("header", F.lit("")) != expected) | (F.col("n") < 2)).orderBy("path").first()
    if first:
        raise ValueError(f"{first['path']}: {'unexpected header' if first['header'] != expected else 'no rows'}")


def read_lists(spark: SparkSession, paths: list[str], release_id: str) -> DataFrame:
    """Records of annual lists: every field trimmed, a byte-order mark removed, with record_id, source_file and release_id."""
    check_headers(spark, paths)
    df = spark.read.schema(LIST_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).csv(paths)
    df = df.select(*[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", "")).alias(c) for c in LIST_COLUMNS], F.regexp_replace(F.input_file_name(), r"^file:/+", "/").alias("source_file"))
    rid = F.sha2(F.concat("source_file", F.chr(F.lit(0)), "paper_id"), 256)
    return df.withColumns({"year": F.col("year").try_cast("int") if hasattr(F.col("year"), "try_cast") else F.expr("try_cast(year AS int)"), "record_id": rid, "release_id": F.lit(release_id)})


def file_hashes(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """path and sha256 of the files below a folder."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return b.select(F.regexp_replace("path", r"^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"))


def digest(hashes: DataFrame, root: str) -> str:
    """One digest of relative paths and file hashes in path order; a list of files, not of rows, comes to the driver."""
    h = hashlib.sha256()
    for r in hashes.orderBy("path").toLocalIterator():
        h.update(str(Path(r["path"]).relative_to(root)).encode())
        h.update(r["sha256"].encode())
    return h.hexdigest()


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """path and change (added, removed or modified) between two manifests."""
    j = before.withColumnRenamed("sha256", "old").join(now.withColumnRenamed("sha256", "new"), "path", "full")
    return j.where("old IS NULL OR new IS NULL OR old <> new").select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified").alias("change"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines; a line that does not parse, or is no object, is an error with its text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def read_labels(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A label file with at least the columns; '|' lists stay text until split."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    gone = set(columns) - set(df.columns)
    if gone:
        raise ValueError(f"{path}: no column {', '.join(sorted(gone))}")
    return df.select(*columns)


def read_export(spark: SparkSession, path: str, columns: list[str], expected: int, unique: str) -> DataFrame:
    """A publisher's export that must have the columns, the number of rows and no repeated key."""
    df = read_labels(spark, path, columns)
    n, keys = df.agg(F.count("*"), F.countDistinct(unique)).first()
    if n != expected or keys != n:
        raise ValueError(f"{path}: {n} rows and {keys} keys where {expected} were expected")
    return df


def read_documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, text and sha256 of the text files below a folder, whole."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return t.select(F.regexp_replace(F.input_file_name(), r"^file:/+", "/").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def read_config(path: str, required: tuple[str, ...]) -> dict:
    """A JSON configuration, refused without the required keys."""
    c = json.loads(Path(path).read_text(encoding="utf-8"))
    gone = [k for k in required if k not in c]
    if gone:
        raise ValueError(f"{path}: no {', '.join(gone)}")
    return c


def read_gzip_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: id, title, summary, authors, published, and total (what the feed says it has in all, null if it does not)."""
    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    x = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    rows = x.select("id", squeeze("title").alias("title"), squeeze("summary").alias("summary"), F.array_join(F.transform("author", lambda a: a["name"]), "; ").alias("authors"), "published")
    total = spark.read.text(path, wholetext=True).agg(F.max(F.regexp_extract("value", r"<(?:\w+:)?totalResults[^>]*>\s*(\d+)", 1).try_cast("bigint")).alias("total"))  # one row
    return rows.join(total)


class _Page(HTMLParser):
    """The entries of a stored page: an element of the entry's class begins one; elements of the fields' classes give its text, links its addresses."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, entry: str, fields: dict[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.entry, self.fields = entry, {v: k for k, v in fields.items()}
        self.rows: list[dict[str, str]] = []
        self.open: list[str | None] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        classes = at.get("class", "").split()
        if self.entry in classes:
            self.rows.append({})
        field = next((self.fields[c] for c in classes if c in self.fields), None)
        if self.rows and tag == "a" and "href" in at:
            self.rows[-1].setdefault("links", "")
            self.rows[-1]["links"] += ("\n" if self.rows[-1]["links"] else "") + at["href"]
        if tag not in self.VOID:
            self.open.append(field)

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag not in self.VOID:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        field = next((f for f in reversed(self.open) if f), None)
        if self.rows and field:
            self.rows[-1][field] = self.rows[-1].get(field, "") + data


def parse_page(page: str | None, entry: str, fields: dict[str, str]) -> list[dict[str, str]]:
    """The entries of a page, blanks squeezed; fields maps a name to the class of its element. Malformed pages give what can be read."""
    p = _Page(entry, fields)
    p.feed(page or "")
    p.close()
    return [{k: v if k == "links" else " ".join(v.split()) for k, v in r.items()} for r in p.rows]


def read_pages(spark: SparkSession, path: str, entry: str, fields: dict[str, str], pattern: str = "*.html") -> DataFrame:
    """path, place, the fields and links (array) of each entry of the stored pages below a folder; a field that is not there is null."""
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, i, r) for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True) for i, r in enumerate(parse_page(t, entry, fields))]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), *[pa.array([g[2].get(n) for g in got], pa.string()) for n in names], pa.array([[x for x in g[2].get("links", "").split("\n") if x] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "place", *names, "links"])

    return read_documents(spark, path, pattern).select("path", "text").mapInArrow(run, f"path string, place int, {', '.join(f'{n} string' for n in names)}, links array<string>")


def page_key(service: str, parameters: dict[str, str]) -> str:
    """The name under which an answer is saved: the same for the same parameters in any order."""
    return hashlib.sha256("\0".join([service, *(f"{k}={v}" for k, v in sorted(parameters.items()))]).encode()).hexdigest()


class PagedSource(DataSource):
    """A paged service behind a folder of its saved answers, one JSON file a page with its rows under 'items'."""

    @classmethod
    def name(cls) -> str:
        return "quire_paged"

    def schema(self) -> str:
        return self.options.get("rowschema", "id string, title string, doi string")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PageReader(self.options["path"], schema.fieldNames())


class _PageReader(DataSourceReader):
    """Pages in the order of their cursors: each names the next under 'next'. Pages that no other names begin a chain."""

    def __init__(self, path: str, fields: list[str]) -> None:
        self.path, self.fields = path, fields

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in json.loads(Path(partition.value).read_text(encoding="utf-8")).get("items", []):
            yield tuple(item.get(f) for f in self.fields)


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the saved answers of a paged service on any file system, with the page and its cursor. An answer is an object with items, and next unless it is the last."""
    text = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    page = text.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("page"), F.from_json("value", f"items array<struct<{schema}>>, next string").alias("a"))
    return page.select("page", F.col("a.next").alias("next"), F.posexplode_outer("a.items").alias("place", "item")).where("item IS NOT NULL").select("page", "next", "place", "item.*")


def missing_pages(answers: DataFrame) -> DataFrame:
    """next: the cursors that an answer names and for which none is saved."""
    return answers.where("next IS NOT NULL AND next <> ''").select("next").distinct().join(answers.select(F.col("page").alias("next")).distinct(), "next", "left_anti")


def looked_up(keys: DataFrame, fetch: Callable[[list[str]], dict[str, str]], batch: int = 100) -> DataFrame:
    """key and value from a service asked in batches; keys without an answer are left out. keys have a column key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column("key").to_pylist()
            for i in range(0, len(ks), batch):
                got = fetch(ks[i : i + batch])
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.string())], names=["key", "value"])

    return keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(run, "key string, value string")
