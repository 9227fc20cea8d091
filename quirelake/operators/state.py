"""User state as pure transforms of snapshots: merges, collections, conversations, plans and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions.columns import url_access
from quirelake.functions.missing import is_missing


def upserted(snapshot: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The snapshot after the changes: of each key the row latest by order; both sides have the same columns."""
    every = snapshot.unionByName(changes)
    rest = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, *[F.col(f"__r.{c}") for c in rest]).select(*every.columns)


def added_if_absent(snapshot: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot with those rows whose keys it lacks; of several new rows of one key, one."""
    new = rows.join(snapshot.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return snapshot.unionByName(new)


def without(snapshot: DataFrame, keys: DataFrame) -> DataFrame:
    """The snapshot without the rows of the keys."""
    return snapshot.join(keys.distinct(), keys.columns, "left_anti")


def replaced(snapshot: DataFrame, rows: DataFrame, document: str) -> DataFrame:
    """The snapshot with all rows of the documents in rows replaced."""
    return without(snapshot, rows.select(document)).unionByName(rows)


def difference(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """key and change (new or gone) against an earlier result."""
    a, b = now.select(key).distinct(), before.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("new")).unionAll(b.join(a, key, "left_anti").withColumn("change", F.lit("gone")))


def history_before(turns: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """Each turn with the n turns before it in its conversation, oldest first."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list("text").over(w))


# Words that lean on the question before, anywhere in a question.
PRONOUNS = ("它", "它们", "这个", "这些", "那个", "那些", "上述", "该", "此", "两者", "二者", "前者", "后者", "上面提到", "刚才", "里面", "其中")


def condensed(turns: DataFrame, conversation: str, order: str, short: int = 12) -> DataFrame:
    """Each question with a standalone form: short ones and those with a pronoun anywhere take the question before, unless it is the same."""
    before = F.trim(F.lag("text").over(Window.partitionBy(conversation).orderBy(order)))
    now = F.trim(F.coalesce("text", F.lit("")))
    leans = (F.length(now) < short) | now.rlike("|".join(PRONOUNS))
    takes = leans & F.coalesce((before != "") & (before != now), F.lit(False))
    return turns.withColumn("standalone", F.when(takes, F.concat_ws(" ", before, now)).otherwise(now))


def cited(text: Column, n: Column) -> Column:
    """The numbers in marks such as [2] that lie within 1 to n, each once, as they first come."""
    marks = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(marks, lambda x: (x >= 1) & (x <= n)))


def ledger(items: DataFrame, session: str, order: str, key: str) -> DataFrame:
    """Each item with the number its key got when it was first seen in its session."""
    first = items.groupBy(session, key).agg(F.min(order).alias("__first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(session).orderBy("__first", key)))
    return items.join(numbered.drop("__first"), [session, key])


def download_plan(papers: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """entity_id, source (catalog, arxiv or none), url, access, estimated_bytes and plan_status of each paper.

    papers: entity_id, pdf_url, arxiv_id; status: entity_id, status of earlier downloads.
    """
    own = ~is_missing(F.col("pdf_url")) & (url_access(F.col("pdf_url")) != "restricted")
    arxiv = ~is_missing(F.col("arxiv_id"))
    clean = F.regexp_replace(F.lower(F.trim("arxiv_id")), r"v\d+$", "")
    p = papers.select(
        "entity_id",
        F.when(own, "catalog").when(arxiv, "arxiv").otherwise("none").alias("source"),
        F.when(own, F.trim("pdf_url")).when(arxiv, F.concat(F.lit("https://arxiv.org/pdf/"), clean)).alias("url"),
        F.when(own, 3_000_000).when(arxiv, 1_500_000).otherwise(0).alias("estimated_bytes"),
    )
    p = p.withColumn("access", url_access(F.coalesce("url", F.lit(""))))
    if status is None:
        return p.withColumn("plan_status", F.when(F.col("source") == "none", "unavailable").otherwise("planned"))
    done = status.groupBy("entity_id").agg(F.max_by("status", F.when(F.col("status") == "success", 3).when(F.col("status") == "duplicate", 2).otherwise(1)).alias("was"))
    state = F.when(F.col("was").isin("success", "duplicate"), "present").when(F.col("source") == "none", "unavailable").when(F.col("was") == "failed", "retry").otherwise("planned")
    return p.join(done, "entity_id", "left").withColumn("plan_status", state).drop("was")


def content_duplicates(files: DataFrame, entity: str, content_hash: str) -> DataFrame:
    """entity and duplicate_of: the first entity with the same content, null for itself."""
    first = files.where(F.col(content_hash).isNotNull()).groupBy(content_hash).agg(F.min(entity).alias("__first"))
    j = files.join(first, content_hash, "left")
    return j.select(entity, F.when(F.col("__first") < F.col(entity), F.col("__first")).alias("duplicate_of"))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """Members of each collection, empty ones included."""
    return collections.join(members, "collection_id", "left").groupBy("collection_id").agg(F.count("entity_id").alias("n"))


def current_members(members: DataFrame, aliases: DataFrame) -> DataFrame:
    """Members with old ids replaced by current ones, each once per collection. aliases: old, current."""
    j = members.join(aliases, F.col("entity_id") == F.col("old"), "left")
    return j.select("collection_id", F.coalesce("current", "entity_id").alias("entity_id")).distinct()


def visible(rows: DataFrame, deletions: DataFrame, key: str) -> DataFrame:
    """Rows whose deletion, if any, was restored."""
    return rows.join(deletions.where("restored_at IS NULL").select(key), key, "left_anti")


def comparison(allowed: DataFrame, cells: DataFrame) -> DataFrame:
    """entity_id, field, value and shown for every allowed paper; cells without evidence are not shown, their papers stay."""
    c = cells.where(F.size("evidence") > 0)
    return allowed.join(c, "entity_id", "left").select("entity_id", "field", "value", F.col("field").isNotNull().alias("shown"))


def scope(requested: DataFrame, *limits: DataFrame) -> DataFrame:
    """The requested ids that all limits allow, each once."""
    out = requested.select("entity_id").distinct()
    for limit in limits:
        out = out.join(limit.select("entity_id"), "entity_id", "left_semi")
    return out


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once with the place at which it first came."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both tables have, each once."""
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def drafted(papers: DataFrame, collections: DataFrame, members: DataFrame, decisions: DataFrame, evidence: DataFrame, operation: str = "classify") -> DataFrame:
    """A suggestion for each paper and target collection: entity_id, collection_id, decision, confidence, reason and already_present.

    papers: entity_id, index_status, parsed_hash; collections (at most 12): collection_id, rule; members: collection_id,
    entity_id; decisions: entity_id, collection_id, rule, decision, confidence, reason; evidence: entity_id. A decision counts if the
    paper is indexed, the rule is the collection's own and not blank, there is evidence of the paper and a reason; else it is for review.
    With operation assign all are included.
    """
    if operation not in ("assign", "classify"):
        raise ValueError(f"unknown operation: {operation}")
    if not 1 <= collections.limit(13).count() <= 12:
        raise ValueError("one to twelve collections")
    pairs = papers.select("entity_id", "index_status", "parsed_hash").join(F.broadcast(collections.select("collection_id", F.coalesce("rule", F.lit("")).alias("rule"))))  # at most 12
    said = decisions.groupBy("entity_id", "collection_id").agg(F.max_by(F.struct(F.col("rule").alias("their_rule"), "decision", "confidence", "reason"), "decision").alias("s"))
    there = members.select("entity_id", "collection_id").distinct().withColumn("already_present", F.lit(True))
    proof = evidence.select("entity_id").distinct().withColumn("proof", F.lit(True))
    j = pairs.join(said, ["entity_id", "collection_id"], "left").join(there, ["entity_id", "collection_id"], "left").join(proof, "entity_id", "left")
    counts = F.coalesce((F.col("index_status") == "indexed_current") & (F.trim("rule") != "") & (F.col("s.their_rule") == F.col("rule")) & F.col("proof") & (F.trim(F.coalesce("s.reason", F.lit(""))) != "") & F.col("s.decision").isin("include", "exclude", "review"), F.lit(False))
    if operation == "assign":
        counts, decision, confidence, reason = F.lit(True), F.lit("include"), F.lit(1.0), F.lit("assigned by the user")
    else:
        decision, confidence, reason = F.col("s.decision"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s.confidence"))), F.col("s.reason")
    return j.select("entity_id", "collection_id", F.when(counts, decision).otherwise("review").alias("decision"), F.when(counts, confidence).otherwise(0.0).alias("confidence"), F.when(counts, reason).otherwise("no decision for this rule, or no evidence").alias("reason"), F.coalesce("already_present", F.lit(False)).alias("already_present"), "parsed_hash")


def applied(suggestions: DataFrame, members: DataFrame, papers: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, expired): the members after a draft. Included pairs (or the chosen ones) are added once; a paper whose text changed since the draft, or is gone, is expired and not added.

    Applying a draft again changes nothing.
    """
    s = suggestions.where("decision = 'include'") if chosen is None else suggestions.join(chosen.select("entity_id", "collection_id"), ["entity_id", "collection_id"], "left_semi")
    now = papers.select("entity_id", F.col("parsed_hash").alias("now"), F.lit(True).alias("there"))
    j = s.join(now, "entity_id", "left").withColumn("ok", F.coalesce("there", F.lit(False)) & F.col("parsed_hash").eqNullSafe(F.col("now")))
    new = added_if_absent(members.select("collection_id", "entity_id"), j.where("ok").select("collection_id", "entity_id"), ["collection_id", "entity_id"])
    return new, j.where("NOT ok").select("entity_id", "collection_id")


def truncated_after(messages: DataFrame, cut: DataFrame) -> DataFrame:
    """Messages without those after a conversation's cut. cut: conversation_id, after (a turn)."""
    return messages.join(cut, "conversation_id", "left").where("after IS NULL OR turn <= after").drop("after")


def snapshots(messages: DataFrame, label: str, created_at: str) -> DataFrame:
    """A snapshot of each conversation: its messages as one JSON text in the order of turns, with their number. A conversation is one person's, so its messages fit a row."""
    g = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    text = F.to_json("m")
    return g.select(F.concat(F.lit("snap_"), F.substring(F.sha2(F.concat("conversation_id", F.chr(F.lit(0)), F.lit(created_at), text), 256), 1, 12)).alias("snapshot_id"), "conversation_id", F.lit(label).alias("label"), text.alias("messages_json"), F.size("m").alias("message_count"), F.lit(created_at).alias("created_at"))


def restored_messages(snapshot: DataFrame) -> DataFrame:
    """The messages of snapshots."""
    m = F.explode(F.from_json("messages_json", "array<struct<turn:int,role:string,text:string>>"))
    return snapshot.select("conversation_id", m.alias("m")).select("conversation_id", "m.*")


def backup(tables: dict[str, DataFrame]) -> DataFrame:
    """format, table_name and row (JSON) of each row of the tables."""
    parts = [df.select(F.lit(BACKUP_FORMAT).alias("format"), F.lit(n).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("row")) for n, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


BACKUP_FORMAT = "personal-v1"


def restored(current: dict[str, DataFrame], saved: DataFrame, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables with the rows of a backup that they lack; rows that are there stay. Refused if the backup has another format, unknown tables, fields or rows that are no objects."""
    names = sorted(current)
    bad = saved.where((F.col("format") != BACKUP_FORMAT) | ~F.col("table_name").isin(*names) | F.from_json("row", "map<string,string>").isNull())
    if not bad.isEmpty():
        raise ValueError("no backup of these tables")
    out = {}
    for n, df in current.items():
        mine = saved.where(F.col("table_name") == n)
        unknown = mine.select(F.explode(F.json_object_keys("row")).alias("k")).where(~F.col("k").isin(*df.columns))
        if not unknown.isEmpty():
            raise ValueError(f"{n}: unknown fields")
        rows = mine.select(F.from_json("row", df.schema).alias("r")).select("r.*")
        out[n] = added_if_absent(df, rows.select(*df.columns), keys[n])
    return out


def collection_rows(members: DataFrame, aliases: DataFrame, papers: DataFrame) -> DataFrame:
    """The rows of each collection for an export, ids resolved and each paper once; papers that are gone are left out. papers: entity_id and what is shown."""
    return current_members(members, aliases).join(papers, "entity_id")
