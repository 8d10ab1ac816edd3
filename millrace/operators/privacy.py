"""Consistent pseudonyms by keyed hash; detection, overlap resolution, mapping and erasure."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hmac_sha256
from ..functions.spans import bound, luhn, matches, mod97, without_overlaps
from ..sources.keyed import KeyedTable

# Detectors as (type, pattern, score), and words that are never personal.
DETECTORS = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0.95),
    ("BUDGET_ID", r"\bBUDGET-\d{4}-\d{4}\b", 0.95),
    ("CLIENT_CODE", r"\b(?:CLI|CLT-INT)-[A-Z0-9]{3,8}\b", 0.9),
    ("PHONE_NUMBER", r"(?:\+34[\s.-]?)?(?:[6789]\d{2})[\s.-]?\d{2,3}[\s.-]?\d{2,3}[\s.-]?\d{0,2}\b", 0.8),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.95),
    ("CREDIT_CARD", r"\b\d(?:[ -]?\d){12,18}\b", 0.9),
]
BLACKLIST = ["mar", "sol", "cruz", "alba", "rosa", "olivia", "angel", "ángel", "alcance", "entregables", "cronograma", "equipo", "presupuesto", "resumen", "proyecto", "cliente", "fase", "fases", "contrato", "cierre", "cuenta", "cuentas", "cargo", "cargos", "cuota"]
THRESHOLD = 0.7
#: What a match of a type must also satisfy: check digits.
CHECKS: dict[str, Callable[[Column], Column]] = {"IBAN_CODE": mod97, "CREDIT_CARD": luhn}


def spans(text: Column, kind: str, pattern: str, score: float) -> Column:
    """Matches of one detector with their positions."""
    found = matches(text, pattern)
    if kind in CHECKS:
        found = F.filter(found, lambda s: CHECKS[kind](s["value"]))
    return F.transform(found, lambda s: F.struct(s["start"], s["stop"], s["at"], F.lit(kind).alias("kind"), F.lit(score).alias("score"), s["value"]))


def gazetteer(kind: str, names: list[str], score: float = 0.85) -> tuple[str, str, float]:
    """A detector of listed names (persons, places, companies), for which there is no model here."""
    return kind, r"(?i)\b(?:" + "|".join(sorted((re.escape(n) for n in names), key=len, reverse=True)) + r")\b", score


def is_blacklisted(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(BLACKLIST)


#: A span that was found: places in code points, and the bytes before it.
SPAN = "struct<start:int,stop:int,at:int,kind:string,value:string>"


def resolved(text: Column, threshold: float = THRESHOLD, detectors: Sequence[tuple[str, str, float]] = tuple(DETECTORS)) -> Column:
    """Spans of all detectors with at least the threshold; where they overlap, the earliest start stands, of
    equal starts the longest, then the surest."""
    every = F.concat(*[spans(text, k, p, s) for k, p, s in detectors if s >= threshold])
    order = F.array_sort(F.transform(every, lambda s: F.struct(s["start"], (-s["stop"]).alias("last"), (-s["score"]).alias("doubt"), s["kind"], s["value"], s["at"])))
    plain = F.transform(order, lambda s: F.struct(s["start"].alias("start"), (-s["last"]).alias("stop"), s["at"].alias("at"), s["kind"].alias("kind"), s["value"].alias("value")))
    return without_overlaps(plain.cast(f"array<{SPAN}>"), SPAN)


def detect(text: Column, threshold: float = THRESHOLD, detectors: Sequence[tuple[str, str, float]] = tuple(DETECTORS)) -> Column:
    """The spans that are to be replaced: those that stand, without words of the blacklist. Overlaps come
    first, so a blacklisted span hides what it overlaps."""
    return F.filter(resolved(text, threshold, detectors), lambda s: ~is_blacklisted(s["value"]))


def detection_report(found: Column) -> Column:
    """(detected, replaced, skipped) of the spans that stand in a text: skipped are blacklisted ones."""
    skipped = F.size(F.filter(found, lambda s: is_blacklisted(s["value"])))
    return F.struct(F.size(found).alias("detected"), (F.size(found) - skipped).alias("replaced"), skipped.alias("skipped"))


def entities_by_type(found: DataFrame, by: str, spans_col: str = "found") -> DataFrame:
    """(by, kind, n): how many spans of each type there are."""
    return found.select(by, F.explode(spans_col).alias("s")).groupBy(by, F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


def _number(digest: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n))


#: How a type's stand-in is made of a digest, so that it has the same shape and needs no shared state. More may be registered.
GENERATORS: dict[str, Callable[[Column], Column]] = {
    "EMAIL_ADDRESS": lambda d: F.concat(F.lit("user"), F.substring(d, 1, 8), F.lit("@example.org")),
    "BUDGET_ID": lambda d: F.concat(F.lit("BUDGET-"), (_number(d, 8) + 2019).cast("string"), F.lit("-"), (_number(d, 9000) + 1000).cast("string")),
    "CLIENT_CODE": lambda d: F.concat(F.lit("CLI-"), (_number(d, 9000) + 1000).cast("string")),
    "IBAN_CODE": lambda d: F.concat(F.lit("XX00"), F.upper(F.substring(d, 1, 16))),
    "CREDIT_CARD": lambda d: F.concat(F.lit("0000 0000 0000 "), F.lpad(_number(d, 10000).cast("string"), 4, "0")),
    "PHONE_NUMBER": lambda d: F.concat(F.lit("+34 600 "), F.lpad(_number(d, 1000000).cast("string"), 6, "0")),
}


def pseudonym(kind: Column, digest: Column, generators: dict[str, Callable[[Column], Column]] = GENERATORS) -> Column:
    """A stand-in for a value of a type, made of its digest; of types without a generator a redaction, so that
    nothing that looks real stands for what isn't known."""
    out = F.concat(F.lit("REDACTED-"), F.substring(digest, 1, 8))
    for name, made in generators.items():
        out = F.when(kind == name, made(digest)).otherwise(out)
    return out


def replace_spans(text: Column, found: Column, key: str) -> Column:
    """The text with each span (in order, without overlaps) replaced by its pseudonym: the pieces between
    spans and the pseudonyms are joined once. The text is cut by bytes, so a piece costs its own length."""

    def joined(spans_: Column, raw: Column) -> Column:
        end = lambda s: s["at"] + F.octet_length(s["value"])
        before = F.transform(spans_, lambda s, i: F.when(i == 0, 0).otherwise(end(F.get(spans_, i - 1))))
        piece = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
        parts = F.zip_with(spans_, before, lambda s, at: F.concat(piece(at, s["at"]), pseudonym(s["kind"], hmac_sha256(key, s["value"]))))
        return F.concat(F.array_join(parts, ""), piece(end(F.element_at(spans_, -1)), F.octet_length(raw)))

    return F.when(F.size(found) > 0, bound(text.cast("binary"), lambda raw: bound(found, lambda spans_: joined(spans_, raw)))).otherwise(text)


def mapping(values: DataFrame, key: str) -> DataFrame:
    """One row for each (entity_type, original_hash) of (entity_type, value, source_name, seen_at)."""
    hashed = values.withColumn("original_hash", hmac_sha256(key, F.col("value")))
    return hashed.groupBy("entity_type", "original_hash").agg(F.count("*").alias("occurrences"), F.min("seen_at").alias("first_seen_at"), F.min_by("source_name", F.struct("seen_at", "source_name")).alias("source_name")).withColumn("pseudonym", pseudonym(F.col("entity_type"), F.col("original_hash")))


def merge_mapping(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the counts of a new mapping to an old one; a pair keeps its pseudonym."""
    return old.unionByName(new).groupBy("entity_type", "original_hash").agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen_at").alias("first_seen_at"), F.min_by("source_name", F.struct("first_seen_at", "source_name")).alias("source_name"), F.min("pseudonym").alias("pseudonym"))


def forget(mapped: DataFrame, key: str, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): all entity types of the values (one column ``value``) go; unknown ones do nothing."""
    gone = values.select(hmac_sha256(key, F.col("value")).alias("original_hash")).distinct()
    return mapped.join(gone, "original_hash", "left_anti"), mapped.join(gone, "original_hash", "left_semi")


class MappingStore:
    """A stored mapping of (entity_type, original_hash) to pseudonyms, filed by hash. Values never reach it:
    they are hashed under the key first."""

    SCHEMA = "entity_type string, original_hash string, pseudonym string, first_seen_at timestamp, source_name string, occurrences long"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.table = KeyedTable.create(spark, path, self.SCHEMA, ["entity_type", "original_hash"], ["original_hash"], buckets)
        self.key = key

    def record(self, values: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Adds sightings (entity_type, value, source_name, seen_at) and returns the version. A pair that is
        known keeps its pseudonym, and when and where it was first seen (as it was recorded), and its
        sightings are counted. A new pair's pseudonym also depends on the version that makes it, so a
        value that comes back after it was forgotten gets another one. Null values are left out."""
        seen = values.where("value is not null").select("entity_type", hmac_sha256(self.key, F.col("value")).alias("original_hash"), F.col("seen_at").cast("timestamp").alias("first_seen_at"), "source_name")
        first = F.struct("first_seen_at", "source_name")
        new = seen.groupBy("entity_type", "original_hash").agg(F.count("*").alias("occurrences"), F.min("first_seen_at").alias("first_seen_at"), F.min_by("source_name", first).alias("source_name"))

        def merge(old: DataFrame, found: DataFrame) -> DataFrame:
            generation = F.lit(str(self.table.version() + 1))
            fresh = found.withColumns({"pseudonym": pseudonym(F.col("entity_type"), hmac_sha256(self.key, F.concat_ws("|", generation, "entity_type", "original_hash"))), "known": F.lit(1)})
            rows = old.withColumn("known", F.lit(0)).unionByName(fresh)
            kept = F.min_by(F.struct("pseudonym", "first_seen_at", "source_name"), "known").alias("kept")
            return rows.groupBy("entity_type", "original_hash").agg(F.sum("occurrences").alias("occurrences"), kept).select("*", "kept.*").drop("kept")

        return self.table.upsert(new, merge, stream, batch)

    def lookup(self, values: DataFrame) -> DataFrame:
        """``values`` (entity_type, value, ...) with their pseudonyms; null where there is none."""
        hashed = values.withColumn("original_hash", hmac_sha256(self.key, F.col("value")))
        return hashed.join(self.table.read().select("entity_type", "original_hash", "pseudonym"), ["entity_type", "original_hash"], "left").drop("original_hash")

    def find(self, pseudonyms: DataFrame) -> DataFrame:
        """The mappings of pseudonyms (one column ``pseudonym``)."""
        return self.table.read().join(pseudonyms.distinct(), "pseudonym", "left_semi")

    def forget(self, values: DataFrame) -> DataFrame:
        """Erases all mappings of values (one column ``value``), whatever their type, and returns them. The old
        files go as well. Unknown values do nothing."""
        gone = self.table.remove(values.where("value is not null").select(hmac_sha256(self.key, F.col("value")).alias("original_hash")))
        self.table.vacuum()
        return gone
