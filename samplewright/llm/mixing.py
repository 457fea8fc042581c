"""Mixing sources to target weights by systematic sampling.

Every source gets a target in words. A document's expected number of copies is
its source's target over its source's size; the copies are prefix-summed within
the source, one offset is added, and a document is emitted once for every
integer boundary that its interval crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..prefix import BUCKET_ROWS
from .common import attach, hash_digits, running_sums, unused, word_count, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """Adds code and target to (source, source_size): shares of the total by weight, each
    at most cap times its source's size, the excess reshared by weight until none is above.

    The resharing ends at min(cap * size, weight * level) for one level, which one
    walk over the sources by cap over weight finds. The table has a row for each source.
    """
    n, w_all = len(weights), Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("code", F.row_number().over(w_all) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("code") % n + 1).cast("int"))
    t = t.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("w"), "code").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("full", F.coalesce(F.sum("most").over(by_ratio), F.lit(0.0)))
    t = t.withColumn("left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0)))
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("left"))
    # the first source, in this order, whose cap is above the level sets it for all that follow
    free = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("full", "level"))).over(every)["level"]
    return t.select("source", "source_size", "code", F.least("most", F.coalesce(free * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", cap: float = MAX_COPIES) -> DataFrame:
    """How often the mix takes each row: (id, source, size, source_size, target, copies, taken).

    Size is the number of words; a null text has none. A null source is a source
    of its own, the last. Within a source, rows are ordered by size, then by a
    hash of the id: neighbours in the walk have about equal sizes, so the words
    taken stay within about one document of the target. Sources without words
    have target 0 and copies 0. Repeated rows are taken on their own. The result
    depends on the rows and the seed only, not on how they are partitioned; of
    rows with one id and one size it may swap the copies. Empty tables give no
    rows; other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).alias("h"),
    )
    rows = written(rows, "sizes").withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = written(sizes, "sources")
    targets = sizes.select("key", "n").join(
        source_targets(sizes.select("source", "source_size"), cap=cap).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source"), "key"
    )
    # one offset a source, in [0, 1)
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("offset"), "key")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    targets = written(targets.withColumn("offset", offset), "targets")
    total = rows.count()
    coded = written(attach(rows, targets, "key", "n", total).withColumn("part", F.substring("h", 1, hash_digits(total))).withColumn("one", F.lit(1)), "coded")
    walk = running_sums(coded.drop("key"), ["code"], ["size", "part"], ["h", "id"], ["one"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    upto = lambda k: F.floor((F.col("before_one") + k) * rate + F.col("offset"))
    copies = F.least(upto(1) - upto(0), F.ceil(F.lit(float(cap)))).cast("long")
    return walk.withColumn("copies", copies).select(
        "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns as they were, each row once per copy that mix decided.

    Rows that share an id are told apart by their size. Rows that share both are
    put in the order of a hash of all their columns and take the copies of their
    group in turn, most first, so that no copy is lost or added.
    """
    got = written(mix(docs).select("id", "size", "copies"), "mix-copies")
    groups = got.groupBy("id", "size").agg(F.count("*").alias("rows"), F.max("copies").alias("copies")).filter("copies > 0")
    name, size = unused(docs, "_mix"), word_count(docs["text"])

    def met(part: DataFrame) -> DataFrame:
        part = part.select(F.struct("*").alias(name))
        return docs.join(part, docs["doc_id"].eqNullSafe(part[f"{name}.id"]) & (size == part[f"{name}.size"]))

    every = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    out = met(groups.filter("rows = 1")).withColumn(name, every(F.col(f"{name}.copies"))).drop(name)
    several = written(groups.filter("rows > 1").select("id", "size", "rows"), "mix-repeats")
    if several.isEmpty():
        return out
    key = F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-")), "size"))
    row = F.struct(*[docs[c] for c in docs.columns])
    total = several.agg(F.sum("rows")).first()[0]
    own = met(several.withColumn("key", key)).select(F.col(name)["key"].alias("key"), row.alias("row"), F.xxhash64(row).alias("h"), F.lit(1).alias("one"))
    own = written(own.withColumn("part", F.pmod("h", F.lit(total // BUCKET_ROWS + 1))), "mix-rows")
    ranked = running_sums(own, ["key"], ["part"], ["h"], ["one"])
    # how many rows of a group take how many copies: at most cap + 1 entries
    shares = got.join(several, got["id"].eqNullSafe(several["id"]) & (got["size"] == several["size"]), "left_semi").withColumn("key", key)
    shares = shares.groupBy("key", "copies").agg(F.count("*").alias("n")).groupBy("key").agg(F.collect_list(F.struct("copies", "n")).alias("shares"), F.sum("n").alias("n"))
    upto = lambda c: F.aggregate(F.filter("shares", lambda x: x["copies"] > c), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    turn = F.filter("shares", lambda x: (upto(x["copies"]) <= F.col("before_one")) & (F.col("before_one") < upto(x["copies"]) + x["n"]))
    dealt = attach(ranked, written(shares, "mix-shares"), "key", "n", total).withColumn("copies", turn[0]["copies"]).filter("copies > 0")
    return out.unionByName(dealt.withColumn("copy", every(F.col("copies"))).select("row.*"))
