"""Removal of lines that many documents share (DataFrame functions only).

1. Lines are normalised to keys, exploded with their positions and hashed; the table of hashes is
   written once.
2. Distinct documents are counted per hash. Spark groups by (hash, document) first, so that a line
   which a third of all documents hold is counted by many tasks before its sums meet.
3. Hashes over the threshold meet the lines' hashes. Those that make up more than a ``HOT``-th of all
   lines are less than ``HOT``, whatever the table's size, and are broadcast; the rest is joined by
   hash, where no hash can be more than a ``HOT``-th of the rows.
4. The positions to drop come back to their texts, which are the only join that carries texts, and
   the stretches between them are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import bound

#: What is stripped from a line's ends.
SPACE = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_CHARS = 40
LEAST_DOCS = 5
#: One over the share of all lines from which a hash is broadcast.
HOT = 10_000


def line_keys(text: Column) -> Column:
    """Keys of a text's lines, in order: both ends stripped of space, A-Z (no other letters) lower-cased."""
    ascii_only = F.octet_length(text) == F.length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.transform(F.split(lower, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))


def _long_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, th, at, h1, h2), a row for each line whose key is long enough: 128 bits stand for the key."""
    numbered = F.transform(line_keys(F.col("text")), lambda key, i: F.struct(i.cast("int").alias("at"), key.alias("key")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "th", F.explode(F.filter(numbered, lambda x: F.length(x["key"]) >= least_chars)).alias("line"))
    return rows.select("id", "th", "line.at", F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit(1), "line.key").alias("h2"))


def _dropped_positions(lines: DataFrame, least_docs: int, hot: int) -> DataFrame:
    """(id, th, drops) of rows that lose lines: their positions in order, each once."""
    lines = cut(lines, "line-hashes")
    often = cut(lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"), F.count("*").alias("lines")).where(F.col("n") >= least_docs).drop("n"), "line-counts")
    total = lines.count()
    names = {"h1": "g1", "h2": "g2"}
    few = often.where(F.col("lines") * hot > total).drop("lines").withColumnsRenamed(names)  # less than ``hot`` rows
    rest = often.where(F.col("lines") * hot <= total).drop("lines").withColumnsRenamed(names)
    same = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    met = lines.join(F.broadcast(few), same, "left")
    goes = F.col("id").isNull() | (F.col("id") < F.col("keeper"))
    settled = met.where(F.col("g1").isNotNull() & goes).select("id", "th", "at")
    others = met.where(F.col("g1").isNull()).drop("g1", "g2", "keeper").join(rest, same).where(goes).select("id", "th", "at")
    return settled.unionByName(others).groupBy("id", "th").agg(F.array_sort(F.collect_set("at")).alias("drops"))


def without(lines: Column, drops: Column) -> Column:
    """The elements of an array whose positions (from 0) aren't in ``drops``, a sorted array: the
    stretches between drops are taken whole, so work is linear in both."""

    def stretches(lines: Column, drops: Column) -> Column:
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(drops, i - 1) + 1)
        return F.transform(F.concat(drops, F.array(F.size(lines))), lambda end, i: F.slice(lines, begin(i) + 1, end - begin(i)))

    # bound, so that the text isn't split anew for each stretch
    return F.flatten(bound(lines, lambda all_: bound(drops, lambda some: stretches(all_, some))))


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot: int = HOT) -> DataFrame:
    """(id, n_lines, n_dropped, kept), a row for each row of ``docs``.

    A line is dropped if its key has ``least_chars`` code points or more and is found in ``least_docs``
    documents or more, but for the largest id that holds it; there all its lines stay. ``kept`` has the
    other lines as they were, joined by line ends.

    A null or empty text is one empty line. Documents are told apart by id: rows that share one count
    once, whatever their texts. Rows without an id don't count, and lose every such line. Repeated
    rows have equal results. Whole texts are split, however long. An empty table gives none. Only the
    two columns named are read.
    """
    drops = _dropped_positions(_long_lines(docs, id_col, text_col, least_chars), least_docs, hot).withColumnsRenamed({"id": "id_d", "th": "th_d"})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = rows.join(drops, F.col("id").eqNullSafe(F.col("id_d")) & (F.col("th") == F.col("th_d")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(without(lines, F.col("drops")), "\n"))
    return got.select("id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
