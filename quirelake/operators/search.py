"""Full-text search: postings, BM25 over weighted columns, prefixes, synonyms, phrases and relaxation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.functions.text import index_tokens, query_tokens

COLUMNS = ("title", "abstract", "authors", "paper_id", "doi", "arxiv_id")
WEIGHTS = (3.0, 2.0, 1.0, 10.0, 10.0, 10.0)
K1, B = 1.2, 0.75

# Words a query leaves out.
STOPWORDS = frozenset("a an the of for and or on in with to is are at by from as vs using based via into".split())
# Abbreviations with the phrases they stand for.
SYNONYMS = {
    "sr": ("super resolution", "superresolution"),
    "llm": ("large language model",),
    "gan": ("generative adversarial network",),
    "nerf": ("neural radiance field",),
    "cnn": ("convolutional neural network",),
    "rnn": ("recurrent neural network",),
    "vae": ("variational autoencoder",),
    "lstm": ("long short term memory",),
    "dnn": ("deep neural network",),
    "mlp": ("multilayer perceptron",),
    "sota": ("state of the art",),
    "ssl": ("self supervised learning",),
    "ood": ("out of distribution",),
    "iou": ("intersection over union",),
    "moe": ("mixture of experts",),
    "slam": ("simultaneous localization and mapping",),
    "dpr": ("dense passage retrieval",),
    "qa": ("question answering",),
    "rlaif": ("reinforcement learning from ai feedback",),
}


@dataclass(frozen=True)
class Phrase:
    """Words one after the other; of the last one, with prefix, any word that begins so."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Match:
    """Groups of phrases: one phrase of each group must be there, or with any_group one phrase of any group."""

    groups: tuple[tuple[Phrase, ...], ...]
    any_group: bool = False


def terms_of(query: str) -> list[str]:
    return [t for t in query_tokens(query) if t not in STOPWORDS]


def match_of(terms: list[str], any_group: bool = False) -> Match:
    groups = []
    for t in terms:
        phrases = [Phrase((t,), True)]
        if not any_group:
            phrases += [Phrase(tuple(s.split())) for s in SYNONYMS.get(t, ())]
        groups.append(tuple(phrases))
    return Match(tuple(groups), any_group)


@dataclass
class Index:
    """postings: token, record_id, col, places; lengths: record_id, length."""

    postings: DataFrame
    lengths: DataFrame

    def write(self, path: str) -> Index:
        """Postings sorted by token, so that a query reads the row groups of its tokens only."""
        spark = self.postings.sparkSession
        # a frequent token is cut by records, so that it fills no task
        self.postings.repartitionByRange("token", "record_id").sortWithinPartitions("token", "record_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def without(self, record_ids: DataFrame) -> Index:
        return Index(self.postings.join(record_ids, "record_id", "left_anti"), self.lengths.join(record_ids, "record_id", "left_anti"))

    def added(self, records: DataFrame) -> Index:
        """With the records that are not in the index yet; adding a record again changes nothing."""
        new = build(records.join(self.lengths.select("record_id"), "record_id", "left_anti"))
        return Index(self.postings.unionByName(new.postings), self.lengths.unionByName(new.lengths))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, cols, tokens, places, sizes = [], [], [], [], []
        columns = [batch.column(c).to_pylist() for c in COLUMNS]
        for i, texts in enumerate(zip(*columns, strict=True)):
            whole = 0
            for c, text in enumerate(texts):
                at: dict[str, list[int]] = {}
                found = index_tokens(text)
                whole += len(found)
                for p, t in enumerate(found):
                    at.setdefault(t, []).append(p)
                for t, ps in at.items():
                    ids.append(i)
                    cols.append(c)
                    tokens.append(t)
                    places.append(ps)
                    sizes.append(0)
            # the record's length, in a row of its own
            ids.append(i)
            cols.append(-1)
            tokens.append("")
            places.append([])
            sizes.append(whole)
        take = pa.array(ids, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("record_id").take(take), pa.array(cols, pa.int32()), pa.array(tokens, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["record_id", "col", "token", "places", "length"])


def build(records: DataFrame) -> Index:
    """The index of records with the columns COLUMNS; null texts have no tokens, repeated ids must be removed before."""
    rows = records.select("record_id", *COLUMNS).mapInArrow(_tokens, "record_id string, col int, token string, places array<int>, length bigint")
    return Index(rows.where("col >= 0").select("token", "record_id", "col", "places"), rows.where("col < 0").select("record_id", "length"))


def _shifted(by: int):
    return F.transform("places", lambda x: x - by)


def _occurrences(index: Index, phrase: Phrase) -> DataFrame:
    """record_id, col and n of each phrase occurrence."""
    p = index.postings
    if len(phrase.words) == 1:
        w = phrase.words[0]
        hit = (F.col("token") >= w) & (F.col("token") < w + "\U0010ffff") & F.col("token").startswith(w) if phrase.prefix else F.col("token") == w
        return p.where(hit).groupBy("record_id", "col").agg(F.sum(F.size("places")).alias("n"))
    hits = p.where(F.col("token").isin(*set(phrase.words)))
    by = hits.groupBy("record_id", "col").agg(*[F.max(F.when(F.col("token") == w, _shifted(i))).alias(f"w{i}") for i, w in enumerate(phrase.words)])
    at = F.col("w0")
    for i in range(1, len(phrase.words)):
        at = F.array_intersect(at, F.col(f"w{i}"))
    return by.select("record_id", "col", F.size(at).alias("n")).where("n > 0")


def search(index: Index, match: Match, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """record_id and rank of the records that match; the lower, the better.

    rank is minus the sum over all phrases of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * length / mean length)),
    f being the weighted occurrences in the columns. An empty match gives no rows.
    """
    spark = index.postings.sparkSession
    if not match.groups:
        return spark.createDataFrame([], "record_id string, rank double")
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("col") + 1)
    parts = []
    for g, phrases in enumerate(match.groups):
        for i, phrase in enumerate(phrases):
            parts.append(_occurrences(index, phrase).groupBy("record_id").agg(F.sum(F.col("n") * w).alias("f")).select("record_id", F.lit(g).alias("g"), F.lit(i).alias("i"), "f"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    corpus = index.lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    counts = every.groupBy("g", "i").agg(F.count("*").alias("n"))  # one row per phrase of the query
    idf = F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    scored = every.join(F.broadcast(counts.join(corpus)), ["g", "i"]).join(index.lengths, "record_id")
    score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.groupBy("record_id").agg((-F.sum(score)).alias("rank"), F.countDistinct("g").alias("groups"))
    return (out if match.any_group else out.where(F.col("groups") == len(match.groups))).select("record_id", "rank")


def resolve(index: Index, query: str) -> tuple[Match, str]:
    """The match of a query and how it came: all terms, any of them if no record has all, or no term at all."""
    terms = terms_of(query)
    if not terms:
        return Match(()), "unsupported_tokens"
    match = match_of(terms)
    if not search(index, match).limit(1).isEmpty():
        return match, "all_terms"
    return match_of(terms, any_group=True), "relaxed_any"


def relaxed(index: Index, query: str) -> tuple[Match, list[str], list[str]]:
    """(match, terms kept, terms dropped): as many terms as still hit a record together.

    Terms without a hit go first; then, while the rest has no hit, the term goes whose absence leaves most
    hits. Which terms each record has is found in one pass: counts per set of terms come to the driver, at
    most two to the power of the number of terms, so the choices need no further job.
    """
    terms = list(dict.fromkeys(terms_of(query)))
    if not terms:
        return Match(()), [], []
    if len(terms) > 20:
        raise ValueError("at most 20 terms")
    masks: DataFrame | None = None
    for i, t in enumerate(terms):
        for phrase in match_of([t]).groups[0]:
            part = _occurrences(index, phrase).select("record_id", F.lit(1 << i).alias("m")).distinct()
            masks = part if masks is None else masks.unionAll(part)
    sets = masks.groupBy("record_id").agg(F.bit_or("m").alias("m")).groupBy("m").agg(F.count("*").alias("n")).collect()
    counts = Counter({r["m"]: r["n"] for r in sets})

    def hits(some: list[str]) -> int:
        want = sum(1 << terms.index(t) for t in some)
        return sum(n for m, n in counts.items() if m & want == want)

    kept = list(terms)
    dropped: list[str] = []
    if not hits(kept):
        dropped = [t for t in terms if not hits([t])]
        kept = [t for t in terms if hits([t])]
        while len(kept) > 1 and not hits(kept):
            best, term = max((hits([t for t in kept if t != x]), x) for x in kept)
            if best == 0:
                term = min(kept, key=lambda t: hits([t]))
            kept.remove(term)
            dropped.append(term)
    return match_of(kept), kept, dropped


def match_metadata(index: Index, query: str) -> dict[str, object]:
    """What is made of a query: mode (browse for a blank one, unsupported_tokens, all_terms or relaxed_any), its terms, and the pieces of other scripts that no token stands for."""
    ignored = re.findall(r"[^\x00-\x7f]+", query or "")
    if not (query or "").strip():
        return {"mode": "browse", "terms": [], "ignored": []}
    _, mode = resolve(index, query)
    return {"mode": mode, "terms": terms_of(query), "ignored": [x.strip() for x in ignored if x.strip()]}


def looked_up_or_found(records: DataFrame, index: Index, text: str) -> DataFrame:
    """record_id of the records with the text as an identifier; if there is none, of those the index finds."""
    known = lookup(records, text).select("record_id")
    if not known.isEmpty():
        return known
    return search(index, resolve(index, text)[0]).select("record_id")


def entity_ranks(hits: DataFrame, memberships: DataFrame) -> DataFrame:
    """entity_id and the best rank of its records."""
    return memberships.join(hits, "record_id").groupBy("entity_id").agg(F.min("rank").alias("rank"))


def recall(index: Index, query: str, least: int = 10) -> tuple[DataFrame, str]:
    """Candidates of a topic: the exact phrase or its plural if it has enough records, else all terms; ranks without weights."""
    words = tuple(query_tokens(query))
    if not words:
        return search(index, Match(())), "none"
    ones = (1.0,) * len(COLUMNS)
    plural = (*words[:-1], words[-1] + "s")
    found = search(index, Match(((Phrase(words), Phrase(plural)),)), ones)
    if found.limit(least).count() >= least:
        return found, "phrase"
    return search(index, match_of(terms_of(query)), ones), "all_terms"


def lookup(records: DataFrame, text: str) -> DataFrame:
    """Records with the text as arXiv id, DOI or paper id; at most 20, as the first answer to a request."""
    t = text.strip()
    return records.where((F.col("arxiv_id") == t) | (F.lower("doi") == t.lower()) | (F.col("paper_id") == t)).orderBy("record_id").limit(20)
