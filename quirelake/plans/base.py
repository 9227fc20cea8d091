"""Shared inputs of the queries, as DataFrames and as SQL, and the filters of the public queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quirelake.functions.columns import all_of, any_of
from quirelake.functions.missing import PLACEHOLDERS
from quirelake.session import released, table

_LIST = ", ".join(f"'{p}'" for p in PLACEHOLDERS)


def sql_missing(c: str) -> str:
    return f"({c} IS NULL OR lower(trim({c})) IN ({_LIST}))"


def sql_count(c: str) -> str:
    return f"count(*) FILTER (WHERE NOT {sql_missing(c)})"


RECORDS = "r AS (SELECT DISTINCT * FROM paper_records)"
ENTITIES = "e AS (SELECT DISTINCT * FROM paper_entities)"
MEMBERS = "m AS (SELECT DISTINCT * FROM entity_memberships)"
LABELS = "l AS (SELECT entity_id, min(area_id) AS area_id, min(nullif(area_secondary, '')) AS direction_id, max(is_non_paper) AS is_non_paper FROM entity_area_assignments WHERE entity_id IS NOT NULL GROUP BY entity_id)"
#: The canonical-entity basis: labelled research entities with the record that stands for them.
BASE = f"""{RECORDS}, {ENTITIES}, {LABELS}, b AS (
  SELECT l.entity_id, l.area_id, l.direction_id, r.record_id, r.venue, r.year, r.title, r.abstract, r.authors
  FROM l JOIN e ON e.entity_id = l.entity_id JOIN r ON r.record_id = e.canonical_record_id WHERE l.is_non_paper = 0)"""


def records(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Records with the given columns; exact repeats of a row count once."""
    return released(spark, d, "paper_records").select("record_id", *[c for c in columns if c != "record_id"])


def entities(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return released(spark, d, "paper_entities").select("entity_id", *[c for c in columns if c != "entity_id"])


def members(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return released(spark, d, "entity_memberships").select("record_id", "entity_id", *[c for c in columns if c not in ("record_id", "entity_id")])


def labels(spark: SparkSession, d: str) -> DataFrame:
    """area_id and direction_id of each labelled entity; the second area serves as the second level."""
    a = table(spark, d, "entity_area_assignments").where("entity_id IS NOT NULL")
    return a.groupBy("entity_id").agg(F.min("area_id").alias("area_id"), F.min(F.expr("nullif(area_secondary, '')")).alias("direction_id"), F.max("is_non_paper").alias("is_non_paper"))


def base(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Labelled research entities joined with their canonical records."""
    r = records(spark, d, "venue", "year", *columns)
    e = entities(spark, d, "canonical_record_id")
    b = labels(spark, d).where("is_non_paper = 0").join(e, "entity_id").join(r, F.col("canonical_record_id") == F.col("record_id"))
    return b.select("entity_id", "area_id", "direction_id", "record_id", "venue", "year", *columns)


KEYS = ("year", "venue", "area", "direction")
COLUMN_OF = {"year": "year", "venue": "venue", "area": "area_id", "direction": "direction_id"}
_LISTS = ("area_ids", "area_names", "direction_names", "direction_ids", "venues", "years", "entity_ids")


@dataclass(frozen=True)
class Filters:
    """Filters of the public queries, all of which must hold. An unknown key, a list over 50 or a text over 200 is refused."""

    area_ids: tuple[str, ...] = ()
    area_names: tuple[str, ...] = ()
    direction_names: tuple[str, ...] = ()
    direction_ids: tuple[str, ...] = ()
    venues: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    entity_ids: tuple[str, ...] = ()
    query: str = ""
    pending_direction: bool = False

    @classmethod
    def of(cls, raw: dict | None) -> Filters:
        raw = dict(raw or {})
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown filter: {', '.join(sorted(unknown))}")
        for key in _LISTS:
            value = raw.get(key, ())
            value = (value,) if isinstance(value, str | int) else tuple(value or ())
            if len(value) > 50:
                raise ValueError(f"{key}: at most 50 values")
            raw[key] = tuple(int(v) for v in value) if key == "years" else tuple(str(v).strip() for v in value if str(v).strip())
        raw["query"] = str(raw.get("query") or "").strip()
        if len(raw["query"]) > 200:
            raise ValueError("query: at most 200 characters")
        raw["pending_direction"] = bool(raw.get("pending_direction", False))
        return cls(**raw)

    def needs(self) -> tuple[str, ...]:
        """Columns of the record that the filters read besides venue and year."""
        return ("title", "abstract", "authors") if self.query else ()

    def apply(self, b: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
        conditions: list[Column] = []
        for values, column in ((self.area_ids, "area_id"), (self.direction_ids, "direction_id"), (self.venues, "venue"), (self.years, "year"), (self.entity_ids, "entity_id")):
            if values:
                conditions.append(F.col(column).isin(*values))
        if self.pending_direction:
            conditions.append(F.col("area_id").isNotNull() & F.col("direction_id").isNull())
        if self.query:
            text = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(self.query.lower())) for c in ("title", "abstract", "authors")]
            conditions.append(text[0] | text[1] | text[2])
        out = b.where(all_of(conditions)) if conditions else b
        for names, column in ((self.area_names, "area_id"), (self.direction_names, "direction_id")):
            if names and definitions is not None:
                hit = any_of([F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(n.lower())) for n in names for c in ("name_zh", "name_en")])
                out = out.join(definitions.where(hit).select(F.col("area_id").alias(column)).distinct(), column, "left_semi")
        return out


# Text keys in SQL, as far as the characters of the tables go: wide forms, ligatures, blanks and two character references.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))).replace("'", "''")
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")


def sql_nfkc(c: str) -> str:
    return f"replace(replace(replace(translate(coalesce({c}, ''), '{_WIDE}', '{_PLAIN}'), 'ﬁ', 'fi'), 'ﬃ', 'ffi'), '…', '...')"


def sql_untagged(c: str) -> str:
    return f"regexp_replace(replace(replace(replace(coalesce({c}, ''), '&nbsp;', chr(160)), '&#45;', '-'), '&amp;', '&'), '<[^>]+>', ' ', 'g')"


def sql_title_key(c: str) -> str:
    return f"regexp_replace(lower({sql_nfkc(c)}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def sql_plain_key(c: str) -> str:
    return sql_title_key(sql_untagged(c))


def sql_phrase(c: str) -> str:
    return f"trim(regexp_replace(lower({sql_nfkc(sql_untagged(c))}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def sql_tokens(c: str) -> str:
    """The tokens of the full-text index."""
    joints = f"regexp_replace(regexp_replace(regexp_replace({sql_nfkc(c)}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g')"
    return f"regexp_extract_all(strip_accents(lower({joints})), '[\\p{{L}}\\p{{N}}]+')"


SQL_DOI = f"CASE WHEN NOT {sql_missing('doi')} THEN nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(doi)), '^(?:https?://)?(?:www\\.|dx\\.)?doi\\.[a-z]+/', ''), '^doi\\s*:\\s*', ''), '[.\\s]+$', ''), '') END"
