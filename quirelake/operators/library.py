"""The local library: downloads, parse results and vectors of papers, reconciled from three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# States of a paper's index, and those that a person must look at.
UNSAFE = ("index_stale", "registry_missing")


def current_ids(rows: DataFrame, aliases: DataFrame, column: str = "entity_id") -> DataFrame:
    """rows with the current id of each entity beside the id it is stored under. aliases: old, current."""
    a = aliases.select(F.col("old").alias("__old"), F.col("current").alias("__current"))
    return rows.withColumnRenamed(column, "storage_id").join(a, F.col("storage_id") == F.col("__old"), "left").withColumn(column, F.coalesce("__current", "storage_id")).drop("__old", "__current")


def index_state(store_known: bool) -> Column:
    """The state of the index of a joined row, see reconciled(); the first that holds."""
    registered = F.coalesce("indexed_chunks", F.lit(0))
    gaps = (F.coalesce("parsed_hash", F.lit("")) == "") | (F.coalesce("indexed_hash", F.lit("")) == "") | (F.coalesce("indexed_fingerprint", F.lit("")) == "") | (registered <= 0)
    stale = (F.coalesce("file_hash", F.lit("")) != F.col("parsed_hash")) | (F.col("indexed_hash") != F.col("parsed_hash")) | (F.col("indexed_fingerprint") != F.col("fingerprint")) | (F.col("chunks") != registered)
    return (
        F.when((F.col("chunks") > 0) & F.col("parse_status").isNull(), "registry_missing")
        .when(F.coalesce("parse_status", F.lit("")) != "success", F.when(F.col("pdf_registered"), "pdf_only").otherwise(""))
        .when(F.coalesce("file_hash", F.lit("")) == "", "parsed_only")
        .when(F.lit(not store_known), "store_unavailable")
        .when(F.col("chunks") == 0, "index_missing")
        .when(gaps, "registry_missing")
        .when(stale, "index_stale")
        .otherwise("indexed_current")
    )


def reconciled(downloads: DataFrame, parsed: DataFrame, vectors: DataFrame, aliases: DataFrame, fingerprint: str, store_known: bool = True) -> DataFrame:
    """One row per storage id known to any of the three sides, with its current entity, states and hashes.

    downloads: entity_id, status, source, file_exists, updated_at; parsed: entity_id, status, file_hash (of the file that
    is there, null if it is gone), parsed_hash, indexed_hash, indexed_fingerprint, indexed_chunks, updated_at; vectors:
    entity_id, chunks. Each side has an id once. Ids that only one side knows are kept.
    """
    d = downloads.select("entity_id", F.col("status").alias("pdf_status"), F.col("source").alias("pdf_source"), "file_exists", F.col("updated_at").alias("d_at"))
    p = parsed.select("entity_id", F.col("status").alias("parse_status"), "file_hash", "parsed_hash", "indexed_hash", "indexed_fingerprint", "indexed_chunks", F.col("updated_at").alias("p_at"))
    j = d.join(p, "entity_id", "full").join(vectors.select("entity_id", F.col("chunks").alias("c")), "entity_id", "full")
    registered = F.coalesce(F.col("pdf_status").isin("success", "duplicate"), F.lit(False))
    j = j.withColumns({"chunks": F.coalesce("c", F.lit(0)) if store_known else F.lit(0), "fingerprint": F.lit(fingerprint), "pdf_registered": registered})
    file = F.when(F.coalesce("file_exists", F.lit(False)), "present").when(registered, "unverified").otherwise("missing")
    out = j.select("entity_id", F.coalesce("pdf_status", F.lit("")).alias("pdf_status"), F.coalesce("pdf_source", F.lit("")).alias("pdf_source"), file.alias("pdf_file"), F.coalesce("parse_status", F.lit("")).alias("parse_status"), (F.coalesce(F.col("parse_status") == "success", F.lit(False)) & (F.coalesce("file_hash", F.lit("")) != "")).alias("text_exists"), index_state(store_known).alias("index_status"), "chunks", F.coalesce("indexed_chunks", F.lit(0)).alias("indexed_chunks"), F.greatest(F.coalesce("d_at", F.lit("")), F.coalesce("p_at", F.lit(""))).alias("updated_at"))
    return current_ids(out, aliases)


def selected_artifacts(items: DataFrame) -> DataFrame:
    """One row per current entity: its best artifact, with the chunks of all, and an unsafe state of any."""
    order = F.struct((F.col("index_status") == "indexed_current").alias("a"), F.col("text_exists").alias("b"), (F.col("pdf_file") == "present").alias("c"), F.col("updated_at").alias("d"), F.col("storage_id").alias("e"))
    rest = [c for c in items.columns if c != "entity_id"]
    g = items.groupBy("entity_id").agg(F.max_by(F.struct(*rest), order).alias("r"), F.count("*").alias("n_artifacts"), F.sum("chunks").alias("all_chunks"), F.min_by("index_status", F.when(F.col("index_status").isin(*UNSAFE), F.col("storage_id"))).alias("unsafe"))
    shown = [F.col(f"r.{c}").alias(c) for c in rest if c not in ("chunks", "index_status")]
    return g.select("entity_id", *shown, F.col("all_chunks").alias("chunks"), F.when((F.col("n_artifacts") > 1) & F.col("unsafe").isNotNull(), F.col("unsafe")).otherwise(F.col("r.index_status")).alias("index_status"), "n_artifacts")


def library_summary(items: DataFrame) -> DataFrame:
    """One row of counts over the states of selected_artifacts."""
    n = lambda c, name: F.count_if(c).alias(name)
    s = F.col("index_status")
    return items.agg(
        n(F.col("pdf_status").isin("success", "duplicate"), "registered_pdfs"),
        n(F.col("pdf_file") == "present", "pdf_files_present"),
        n((F.col("parse_status") == "success") & F.col("text_exists"), "parsed"),
        *[n(s == v, v) for v in ("indexed_current", "index_stale", "index_missing", "registry_missing")],
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.max(F.when(s == "indexed_current", F.col("updated_at"))), F.lit("")).alias("last_ingest_at"),
    )


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(F.coalesce(column, F.lit("")).alias("status")).agg(F.count("*").alias("n"))


def storage_choice(rows: DataFrame) -> DataFrame:
    """entity_id and storage_id: of the ids an entity is stored under, one that succeeded, else was a duplicate, else the current one, else the first."""
    rank = F.when(F.col("status") == "success", 0).when(F.col("status") == "duplicate", 1).when(F.col("storage_id") == F.col("entity_id"), 2).otherwise(3)
    return rows.groupBy("entity_id").agg(F.min_by("storage_id", F.struct(rank.alias("r"), "storage_id")).alias("storage_id"))


def stale(report: DataFrame, release: DataFrame) -> DataFrame:
    """report_id and stale: whether the report's digest is not that of the active release (one row: source_digest); a rebuild of the same content is not stale."""
    return report.join(release.select(F.col("source_digest").alias("__active"))).select("report_id", (~F.col("source_digest").eqNullSafe(F.col("__active"))).alias("stale"))


def ingest_results(items: DataFrame, download: DataFrame, parse: DataFrame, ingest: DataFrame) -> DataFrame:
    """entity_id, stage and outcome of each item: how far it came. A duplicate of another's file is not parsed again.

    download: entity_id, status, duplicate_of; parse and ingest: entity_id, status.
    """
    j = items.select("entity_id").distinct().join(download.select("entity_id", F.col("status").alias("d"), "duplicate_of"), "entity_id", "left").join(parse.select("entity_id", F.col("status").alias("p")), "entity_id", "left").join(ingest.select("entity_id", F.col("status").alias("i")), "entity_id", "left")
    same = F.col("duplicate_of").isNotNull()
    stage = F.when(F.coalesce(F.col("i") == "success", F.lit(False)), "indexed").when(same, "duplicate").when(F.coalesce(F.col("p") == "success", F.lit(False)), "parsed").when(F.coalesce(F.col("d").isin("success", "duplicate"), F.lit(False)), "downloaded").otherwise("requested")
    failed = (F.coalesce("d", F.lit("")) == "failed") | (F.coalesce("p", F.lit("")) == "failed") | (F.coalesce("i", F.lit("")) == "failed")
    return j.select("entity_id", stage.alias("stage"), F.when(failed & (stage != "indexed"), "failed").when(stage.isin("indexed", "duplicate"), "done").otherwise("pending").alias("outcome"))


def parseable(download: DataFrame) -> DataFrame:
    """entity_id of the downloads to parse: one for each content. download: entity_id, status, sha256."""
    ok = download.where("status IN ('success', 'duplicate')")
    return ok.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("entity_id").alias("entity_id")).select("entity_id").unionAll(ok.where("sha256 IS NULL").select("entity_id"))


def library_view(items: DataFrame, saved: DataFrame) -> DataFrame:
    """entity_id, index_status (null where only saved) and the sorted ids of the collections of every local or saved paper. saved: entity_id, collection_id."""
    s = saved.groupBy("entity_id").agg(F.array_sort(F.collect_set("collection_id")).alias("collections"))
    return items.select("entity_id", "index_status").join(s, "entity_id", "full").select("entity_id", "index_status", F.coalesce("collections", F.array().cast("array<string>")).alias("collections"))


def cleaned(downloads: DataFrame, parsed: DataFrame, vectors: DataFrame, ids: DataFrame, what: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a cleanup of the ids: pdf, parse (vectors go with it), ingest (vectors only) or all."""
    if what not in ("pdf", "parse", "ingest", "all"):
        raise ValueError(f"unknown cleanup: {what}")
    gone = ids.select("entity_id").distinct()
    without = lambda df, yes: df.join(gone, "entity_id", "left_anti") if yes else df
    unindexed = parsed
    if what == "ingest":
        mark = gone.withColumn("__gone", F.lit(True))
        j = parsed.join(mark, "entity_id", "left")
        unindexed = j.select(*[F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c.startswith("indexed_") else F.col(c) for c in parsed.columns])
    return without(downloads, what in ("pdf", "all")), without(unindexed, what in ("parse", "all")), without(vectors, what in ("parse", "ingest", "all"))


def publication_review(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """record_id and status of each record by venue, year and paper id, also under a journal's other id; 'unreviewed' where there is none.

    reviews: venue, year, paper_id, other_paper_id (may be null), status; of several the smallest status holds.
    """
    keys = reviews.select("venue", "year", F.explode(F.array_compact(F.array("paper_id", "other_paper_id"))).alias("paper_id"), "status").groupBy("venue", "year", "paper_id").agg(F.min("status").alias("status"))
    return records.select("record_id", "venue", "year", "paper_id").join(keys, ["venue", "year", "paper_id"], "left").select("record_id", F.coalesce("status", F.lit("unreviewed")).alias("status"))
