"""One query for each operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, langid, line_dedup, mixing, phrases, pii, resampling, secret_scan, simhash, tokens, toxicity, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    got = toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)
    return got.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), cycle=(5, 2, 1), share=1.5, most=2.0)
    return mixing.taken_in_order(plan).withColumnRenamed("id", "doc_id")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS o FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS most FROM s
), o AS (
  SELECT *, most / weight AS stop,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, place, CASE WHEN f IS NULL THEN most ELSE least(f * weight, most) END AS target
  FROM o, (SELECT first(level ORDER BY stop, place) FILTER (level <= stop) AS f FROM o)
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.place,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  -- the schedules' linear pieces: weight w0 at t0 to w1 at t1, share of the integral before (done) and in it (part)
  SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE), (1, 0.0, 1.0, 2.0, 0.5, 0.0, 1.0),
    (2, 0.0, 0.5, 0.5, 1.0, 0.0, 0.375::DOUBLE / 1.125::DOUBLE), (2, 0.5, 1.0, 1.0, 2.0, 0.375::DOUBLE / 1.125::DOUBLE, 0.75::DOUBLE / 1.125::DOUBLE)) AS c(schedule, t0, t1, w0, w1, done, part)
), f AS (
  SELECT doc_id, size, place, CASE WHEN target > 0 THEN (middle + k * source_size) / target ELSE 0.0::DOUBLE END AS fraction
  FROM q, (SELECT unnest([0, 1]) AS k) WHERE middle + k * source_size < target
), x AS (
  SELECT f.*, c.*, least(greatest((fraction - done) / part, 0.0::DOUBLE), 1.0::DOUBLE) AS x, w1 - w0 AS slope, (w0 + w1) / 2 AS area
  FROM f JOIN c ON f.place % 3 = c.schedule AND c.done <= f.fraction
  QUALIFY row_number() OVER (PARTITION BY doc_id, fraction ORDER BY done DESC) = 1
), p AS (
  SELECT doc_id, size, t0 + (t1 - t0) * least(greatest(CASE WHEN abs(slope) < 1e-12 THEN x ELSE (sqrt(greatest(w0 * w0 + 2 * slope * area * x, 0.0::DOUBLE)) - w0) / slope END, 0.0::DOUBLE), 1.0::DOUBLE) AS position FROM x
), g AS (
  SELECT doc_id, count(*) AS times, min(position) AS first_position, max(position) AS last_position, min(b) AS first_begin, max(b) AS last_begin
  FROM (SELECT *, coalesce(sum(size) OVER (ORDER BY position, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM p) GROUP BY doc_id
)
SELECT q.doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken, coalesce(first_position, -1.0::DOUBLE) AS first_position, coalesce(last_position, -1.0::DOUBLE) AS last_position, coalesce(first_begin, -1)::BIGINT AS first_begin, coalesce(last_begin, -1)::BIGINT AS last_begin FROM q LEFT JOIN g ON q.doc_id = g.doc_id
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), "item_id", F.col("start").alias("first_word"), F.col("until").alias("end_word"), F.col("n_match").alias("n_match"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = phrases.drop_repeated_passages(table(spark, sf_dir, "documents"), width=13)
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d)
), lo AS MATERIALIZED (
  SELECT t, min(doc_id) AS least FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)
), gone AS MATERIALIZED (
  SELECT DISTINCT win.doc_id, p + k AS p FROM win JOIN lo USING (t), (SELECT unnest(range(0, 13)) AS k) WHERE lo.least < win.doc_id
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY words.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_tokens(table(spark, sf_dir, "documents"), tokens.default_tokenizer())
    return tokens.read_index(files)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = langid.train_profiles(docs.where(~held_out))
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan_pii(table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    return got.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), grams=1, buckets=10_000, least_words=20)
    return got.withColumnRenamed("id", "doc_id")


OP12_SQL = r"""
WITH tab AS (
  -- the table of CRC-32 (reflected polynomial EDB88320), by shifting each byte out
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS tab
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), dw AS MATERIALIZED (
  SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w
), v AS MATERIALIZED (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::INT]))) % 10000 AS k
  FROM (SELECT w FROM dw UNION SELECT w FROM b), tab
), s AS (
  SELECT k, sum(n) AS n FROM dw JOIN v USING (w) GROUP BY k
), t AS (
  SELECT k, count(*) AS n FROM b JOIN v USING (w) GROUP BY k
), g AS (
  SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)
), m AS (
  SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM dw JOIN v USING (w) JOIN g USING (k) GROUP BY r
), x AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (r)
), y AS (
  SELECT doc_id, n_features, weight::BIGINT AS weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM x
), z AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) END AS place FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN place END::BIGINT AS rank FROM z
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), least_chars=40, least_docs=5)
    return got.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = """
WITH l AS MATERIALIZED (
  SELECT r, doc_id, p, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(range(len(lines))) AS p, unnest(lines) AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), o AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT l.*, o.k IS NOT NULL AND (doc_id IS NULL OR doc_id < keeper) AS gone FROM l LEFT JOIN o ON l.k = o.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_source_mixing, op3_secret_scan, op4_simhash_near_dedup, op5_benchmark_decontamination, op6_substring_dedup, op7_nearest_neighbours, op8_token_output, op9_language_id, op10_pii, op11_embedding_whitening, op12_importance_resampling, op13_line_dedup)}
ORACLES: dict[str, str] = {"op2_source_mixing": OP2_SQL, "op6_substring_dedup": OP6_SQL, "op12_importance_resampling": OP12_SQL, "op13_line_dedup": OP13_SQL}
