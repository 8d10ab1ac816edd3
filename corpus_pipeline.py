"""From documents to token files, in five stages; each is an operator of ``millrace.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, simhash, tokens
from millrace.llm.common import fresh, new_folder, table

#: A document is rejected if it has no letter, or is as far as this from every language's profile.
MIN_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are near to a language; those without letters or near to none go. A score
    of just ``MIN_LANGUAGE_SCORE`` stays; of equally near languages the first by name is meant."""
    lang, score = fresh(docs, "judged_lang", "judged_score")
    judged = langid.identify(docs, langid.train_profiles(docs), lang_name=lang, score_name=score)
    return judged.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return simhash.keep_one_of_each(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents of the mix, as often as it takes them; its files and their rows are in training order."""
    return mixing.mix(docs)


def stored_order(docs: DataFrame) -> list:
    """The place of each row in what the stage before wrote: its file (their names ascend with the
    partition) and its row in the file. A table without files is in the order of its partitions."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() == "LogicalRelation":
        return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return [F.monotonically_increasing_id()]


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the order of the rows and returns what they hold: doc_id, start, n_tokens, ids_crc32."""
    return tokens.read_index(tokens.write_tokens(docs, tokens.default_tokenizer(), order=stored_order(docs)))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mix),
    ("token_output", token_output),
]

#: Profiles, fingerprints and tokenizers can't be written in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}-{name}")
    return docs
