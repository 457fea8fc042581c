"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums over that histogram
answer totals, quantiles and totals truncated at any context limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_sums, written
from .tokens import byte_bpe, texts_of, tokenizer_path

#: Context limits that are reported whether or not a document has that length.
LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
#: Lengths that one task sums together.
STRETCH = 512


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row's whole text under the byte-level BPE at path; null and empty texts have 0."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(path, pattern)
        for b in batches:
            counts = [len(encode(t)) for texts in texts_of(b, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens bigint")


def length_table(lengths: DataFrame, limits: Sequence[int] = LIMITS) -> DataFrame:
    """One row per distinct length and per limit, from (n_tokens).

    context_limit; docs with exactly that many tokens; docs_within and
    tokens_within (at most that many); docs_over and tokens_over (more);
    truncated_tokens, the total when every document is cut at the limit; and
    n_docs and n_tokens of the corpus. Between two neighbouring rows the
    truncated total is linear in the limit, so the table answers every limit.
    An empty table gives a row of zeros for each limit.
    """
    spark = lengths.sparkSession
    asked = spark.createDataFrame([(int(x), 0) for x in limits], "length bigint, docs bigint")
    counted = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("docs"))
    hist = counted.unionByName(asked).groupBy("length").agg(F.sum("docs").alias("docs"))
    hist = written(hist.withColumns({"tokens": F.col("length") * F.col("docs"), "stretch": F.floor(F.col("length") / STRETCH)}), "histogram")
    total = hist.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    sums = running_sums(hist, [], ["stretch"], ["length"], ["docs", "tokens"])
    within, tokens = F.col("before_docs") + F.col("docs"), F.col("before_tokens") + F.col("tokens")
    over = F.lit(total["d"]) - within
    return sums.select(
        F.col("length").alias("context_limit"),
        "docs",
        within.alias("docs_within"),
        tokens.alias("tokens_within"),
        over.alias("docs_over"),
        (F.lit(total["t"]) - tokens).alias("tokens_over"),
        (tokens + F.col("length") * over).alias("truncated_tokens"),
        F.lit(total["d"]).cast("long").alias("n_docs"),
        F.lit(total["t"]).cast("long").alias("n_tokens"),
    )


def quantiles(table: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents do not exceed."""
    asked = table.filter("docs > 0").withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    need = F.greatest(F.ceil(F.col("share") * F.col("n_docs")), F.lit(1))
    return asked.filter((F.col("docs_within") >= need) & (F.col("docs_within") - F.col("docs") < need)).select("share", F.col("context_limit").alias("n_tokens"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """(context_limit, truncated_tokens) for one limit, whether or not it has a row."""
    cut = F.least(F.col("context_limit"), F.lit(int(limit)))
    return table.agg(F.lit(int(limit)).alias("context_limit"), F.coalesce(F.sum(cut * F.col("docs")), F.lit(0)).alias("truncated_tokens"))
