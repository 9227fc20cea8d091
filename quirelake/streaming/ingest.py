"""Incremental ingestion of single entries as a stream: an extension, as the catalogue itself is built in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelake.functions.missing import is_missing
from quirelake.functions.text import title_key_col

ENTRY_SCHEMA = "record_id string, title string, authors string, arxiv_id string, arrived_at timestamp"


def outcomes(entries: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, outcome and entity_id of each entry: exists (the id is known), merged (a canonical record has its title) or new.

    records: record_id, title, entity_id, is_canonical and, if it is there, tkey, the title's key, which then is not made again. Entries without an id or title are new or left out as they
    have an id or not; of repeated entries one is kept; of several entities with the title the smallest holds.
    """
    e = entries.where("record_id IS NOT NULL").dropDuplicates(["record_id"]).withColumn("tkey", F.when(~is_missing(F.col("title")), title_key_col(F.col("title"))))
    known = records.groupBy("record_id").agg(F.min("entity_id").alias("known"))
    keyed = records if "tkey" in records.columns else records.withColumn("tkey", title_key_col(F.col("title")))
    titled = keyed.where("is_canonical = 1 AND tkey <> ''").groupBy("tkey").agg(F.min("entity_id").alias("same"))
    fresh = F.concat(F.lit("ape_"), F.substring(F.sha2(F.concat(F.lit("record:"), F.col("record_id")), 256), 1, 24))
    j = e.join(known, "record_id", "left").join(titled, "tkey", "left")
    return j.select("record_id", F.when(F.col("known").isNotNull(), "exists").when(F.col("same").isNotNull(), "merged").otherwise("new").alias("outcome"), F.coalesce("known", "same", fresh).alias("entity_id"))


def start(spark: SparkSession, source: str, catalog: str, sink: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Reads entries that arrive as Parquet files and appends the outcome of each to the sink.

    An entry that comes again within the delay is dropped by its id. The keys of the catalogue's titles are made once, beside
    the checkpoint, and read for each micro-batch, with what earlier batches of this stream have added. The sink is written per batch number, so that a batch that is run again
    after a failure replaces its own output. A new release of the catalogue takes a new checkpoint.
    """
    keys = f"{checkpoint}-catalog-keys"
    known_at_start = spark.read.parquet(catalog).select("record_id", "entity_id", "is_canonical", title_key_col(F.col("title")).alias("tkey"))
    known_at_start.write.mode("ignore").parquet(keys)
    entries = spark.readStream.schema(ENTRY_SCHEMA).parquet(source).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["record_id"])

    def batch(df: DataFrame, n: int) -> None:
        known = spark.read.parquet(keys).select("record_id", "entity_id", "is_canonical", "tkey")
        try:
            before = spark.read.parquet(sink).where(F.col("batch") < n)
            known = known.unionAll(before.select("record_id", "entity_id", F.when(F.col("outcome") == "new", 1).otherwise(0).alias("is_canonical"), title_key_col(F.col("title")).alias("tkey")))
        except Exception as e:  # the first batch finds no sink
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        out = outcomes(df, known).join(df.select("record_id", "title").dropDuplicates(["record_id"]), "record_id")
        out.write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by window and type; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean")
