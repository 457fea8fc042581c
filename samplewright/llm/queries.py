"""The registered queries opN_<name> and their SQL, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, filter_audit, hard_negatives, jaccard_join, language, licences, mixing, packing, sharding, substring_dedup, token_counts, warc
from .common import read


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(read(spark, sf_dir, "documents"))
    return placed.withColumnRenamed("id", "doc_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"), k=3, percent=90).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (
  SELECT doc_id, len(s)::BIGINT AS n FROM s
), e AS (
  SELECT doc_id, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
), b AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.c FROM r JOIN b ON r.doc_id = b.x
)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY ALL
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "end", F.col("other_id").alias("other_doc_id"), "other_start", "other_end", "similarity")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), exact_dedup.arrival(), exact_dedup.N_BATCHES)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "canonical_sha256", "licence", F.concat_ws(",", "notices").alias("notices"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_table(token_counts.encoded_lengths(read(spark, sf_dir, "documents")))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), s AS (
  SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY key
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS code FROM s
), c AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][code % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS most FROM w
), f AS (
  SELECT *, coalesce(sum(most) OVER r, 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS free
  FROM c WINDOW r AS (ORDER BY most / weight, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (sum(source_size) OVER () - filled) / free AS level FROM f
), t AS (
  SELECT key, source_size,
         least(most, coalesce((SELECT arg_min(level, filled) FROM l WHERE level * weight <= most) * weight, most)) AS target,
         ('0x' || substr(md5('mix|offset|' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS offs
  FROM l
), p AS (
  SELECT d.*, source_size, target, offs,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.key ORDER BY size, h, doc_id) - 1 AS before
  FROM d JOIN t ON d.key = t.key
), q AS (
  SELECT *, least(floor((before + 1) * rate + offs) - floor(before * rate + offs), 3)::BIGINT AS copies FROM p
)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM q
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").filter(F.col("label").isNotNull() & hard_negatives.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), v.alias("v")), F.col("vec_id") % 100 == 0)


OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b))::INTEGER AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.converted(read(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_licence_scan": op8_licence_scan,
    "op9_token_counts": op9_token_counts,
    "op10_mix": op10_mix,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {"op4_jaccard_join": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_licence_scan": licences.scan_sql(), "op10_mix": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_warc": warc.warc_sql(), "op13_filter_audit": filter_audit.audit_sql()}
