"""Files of a folder: listing, census, JSON records, CSV, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_path(location: Column, root: str) -> Column:
    """``scheme://logical/path`` below a root folder."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.btrim(F.regexp_replace(location, r"^[^:/]*://", ""), F.lit("/")))


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, modified, content) of the files below a folder, at any depth. Bytes are only
    read where ``content`` is used. A folder that is missing has no files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    try:
        files = reader.load(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, name string, bytes long, modified timestamp, content binary")
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files of a folder in order of their path, without their bytes."""
    return read_files(spark, folder, pattern).drop("content").orderBy("path")


def census(files: DataFrame, by: list[str]) -> DataFrame:
    """Number, size in MB, last change and formats (name endings) of the files of each group, and of all (``by`` null)."""
    ending = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    rows = files.withColumn("__ending", F.nullif(ending, F.lit("")))
    return rows.rollup(*by).agg(F.count("*").alias("files"), F.round(F.sum("bytes") / 1e6, 3).alias("size_mb"), F.max("modified").alias("last_change"), F.array_sort(F.collect_set("__ending")).alias("formats"))


def decode(content: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where they are none."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def json_records(files: DataFrame, schema: str) -> DataFrame:
    """(record..., source_file, broken) of files that each hold one JSON object or an array of them.

    A file that is no JSON gives one row with ``broken`` true and all fields null, so one bad file
    doesn't lose a source.
    """
    text = F.trim(decode(F.col("content")))
    whole = F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text)
    # A json of another shape would parse to nulls, so validity is asked of the parser itself.
    bad = F.expr("try_parse_json(__text)").isNull()
    rows = files.select("path", whole.alias("__text")).withColumn("broken", bad)
    parsed = F.when(~F.col("broken"), F.from_json("__text", f"array<struct<{schema}>>"))
    return rows.select("path", "broken", F.explode_outer(parsed).alias("r")).select("r.*", F.col("path").alias("source_file"), "broken")


def csv_rows(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, rows without an error) of CSV files with a header; ``error`` is blank where all went well."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    return rows, rows.where(F.coalesce(F.trim("error"), F.lit("")) == "")


def write_csv(rows: DataFrame, folder: str, columns: list[str]) -> None:
    """The named columns as CSV files with a header; other columns are left out."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def texts(files: DataFrame) -> DataFrame:
    """(path, name, text) of text files."""
    return files.select("path", "name", decode(F.col("content")).alias("text"))
