"""Near duplicates among embeddings: ITQ codes, multi-index Hamming tables, rerank.

Iterative quantisation (Gong and Lazebnik, 2011) learns, on a bounded sample, a
rotation of the principal components for which the signs lose least; from two
starts, two rotations. Every vector gets a binary code of their signs. A table
takes some of the code's bits, about as many as the number of vectors needs for
buckets of BUCKET; codes that agree on them are candidates if they are near
enough as a whole. How near, and how many tables, is measured on pairs of
sampled vectors at the threshold. Candidates are verified with the original
vectors, in double precision. Equal vectors are one class throughout. Where the
tables that a table of vectors can pay for do not reach the share asked for (all
vectors lie close together, say), nothing is left to chance: all vectors meet, in
bounded blocks, and a warning says so.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, components, written

THRESHOLD = 0.9
#: Bits of one rotation at most; a code has twice as many.
BITS = 64
#: Rows on which the rotations are learnt and the tables chosen.
SAMPLE = 10_000
ITERATIONS = 40
#: Share of pairs right at the threshold that must be candidates, and vectors on which this is measured.
RECALL, PROBED = 0.97, 1000
#: Unrelated vectors of a bucket, about.
BUCKET = 8
#: Tables at most: from a table for every 64 vectors on, comparing all in blocks costs no more than filling the tables.
LEAST_TABLES, MOST_TABLES, TABLE_PAYS = 64, 4096, 64
#: Codes of one bucket, and vectors of one code, that are compared as a block; vectors of a block where all meet.
CODES, BLOCK, WIDE_BLOCK = 2048, 256, 1024


def learn_rotation(x: np.ndarray, bits: int = BITS, iterations: int = ITERATIONS, start: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection d x bits): signs of (x - mean) @ projection are balanced codes."""
    mean = x.mean(axis=0)
    c = x - mean
    bits = min(bits, x.shape[1])
    vectors = np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :bits]
    v = c @ vectors
    r = np.linalg.qr(np.random.default_rng(start).standard_normal((bits, bits)))[0]
    for _ in range(iterations):
        left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (left @ right).T
    return mean, vectors @ r


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.array(rows, float)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    """Mean, projection (d x 2 bits), a table a row of masks (two words), the bits by which candidates may differ,
    and the share of pairs at the threshold, of the kind that fares worst, that meet in some table."""

    mean: np.ndarray
    projection: np.ndarray
    masks: np.ndarray
    most: int
    share: float

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Two words a vector."""
        signs = (unit - self.mean) @ self.projection >= 0
        half = signs.shape[1] // 2
        place = np.uint64(1) << np.arange(half, dtype=np.uint64)
        return np.column_stack([(s * place).sum(axis=1, dtype=np.uint64) for s in (signs[:, :half], signs[:, half:])]).view(np.int64)


def near_pairs(unit: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the threshold's very cosine, made from sampled vectors by turning them
    towards one another and in random directions, and the sample's own near pairs."""
    rng = np.random.default_rng(11)
    x = unit[rng.permutation(len(unit))[:PROBED]]
    pairs = []
    for to in (np.roll(x, 1, axis=0), rng.standard_normal(x.shape)):
        off = to - (to * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((off * off).sum(axis=1))
        fine = size > 1e-6
        pairs.append((x[fine], threshold * x[fine] + np.sqrt(max(0.0, 1 - threshold**2)) * off[fine] / size[fine, None]))
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    some = rng.permutation(len(i))[: 10 * PROBED]
    return [*pairs, (x[i[some]], x[j[some]])]


def learn(unit: np.ndarray, n: int, threshold: float, bits: int = BITS) -> Index:
    """The index for n vectors, from a sample of them.

    The tables deal out the code's bits from one shuffled pack after the other,
    and are added until RECALL of each kind of near_pairs meet in one, or until
    comparing all vectors would cost no more; the share reached is told.
    """
    (mean, one), (_, two) = (learn_rotation(unit, bits, start=s) for s in (7, 13))
    projection = np.hstack([one, two])
    width = projection.shape[1]
    apart = [((a - mean) @ projection >= 0) != ((b - mean) @ projection >= 0) for a, b in near_pairs(unit, threshold) if len(a)]
    most = max([int(np.quantile(x.sum(axis=1), 0.999, method="higher")) for x in apart], default=width)
    w = min(max(1, math.ceil(math.log2(max(2, n / BUCKET)))), max(1, width // 3))
    rng, deck, masks = np.random.default_rng(5), np.empty(0, np.int64), []
    open_ = [np.ones(len(x), bool) for x in apart]
    most_tables = min(MOST_TABLES, max(LEAST_TABLES, n // TABLE_PAYS))
    while len(masks) < most_tables and (not masks or any(o.mean() > 1 - RECALL for o in open_)):
        if len(deck) < w:
            deck = rng.permutation(width)
        at, deck = deck[:w], deck[w:]
        open_ = [o & x[:, at].any(axis=1) for o, x in zip(open_, apart, strict=True)]
        half = width // 2
        masks.append([sum(1 << int(i) for i in at if i < half), sum(1 << int(i - half) for i in at if i >= half)])
    return Index(mean, projection, np.array(masks, np.uint64), most, float(min((1 - o.mean() for o in open_), default=1.0)))


def fitted(vectors: DataFrame, n: int, threshold: float = THRESHOLD, sample: int = SAMPLE) -> Index:
    """Learns the index in one task, on at most `sample` rows of usable (id, v) by a hash of the id; the driver gets the index alone."""
    h = F.xxhash64(F.lit("itq"), "id")
    near = vectors.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < float(1 << 30) * min(1.0, 2 * sample / max(n, 1)))

    def solve(t: pa.Table) -> pa.Table:
        v = t.sort_by([("h", "ascending"), ("id", "ascending")]).column("v").combine_chunks()
        own = learn(_unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)), n, threshold)
        raw = [own.mean.tobytes(), own.projection.tobytes(), own.masks.tobytes()]
        return pa.table([*[pa.array([x], pa.binary()) for x in raw], pa.array([own.most], pa.int32()), pa.array([own.share])], ["mean", "projection", "masks", "most", "share"])

    schema = "mean binary, projection binary, masks binary, most int, share double"
    got = near.orderBy("h", "id").limit(sample).select("h", "id", F.col("v").cast("array<double>").alias("v")).groupBy(F.lit("index")).applyInArrow(solve, schema).first()
    mean = np.frombuffer(got["mean"])
    return Index(mean, np.frombuffer(got["projection"]).reshape(len(mean), -1), np.frombuffer(got["masks"], np.uint64).reshape(-1, 2), got["most"], got["share"])


def encode(vectors: DataFrame, index: Index) -> DataFrame:
    """(id, c0, c1, vec) of usable (id, v): the code and the unit vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                v = part.column("v")
                unit = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                code = index.codes(unit)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "c0", "c1", "vec"])

    return vectors.select("id", "v").mapInArrow(run, "id bigint, c0 bigint, c1 bigint, vec binary")


def near_codes(codes: DataFrame, masks: np.ndarray, most: int) -> DataFrame:
    """Pairs a, b of distinct codes (code, c0, c1) that agree on all bits of some mask and differ in at most `most`, each once.

    A pair that several tables hold is kept at the first of them. Buckets of more
    than CODES codes are cut into parts, and part meets part.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("m0"), F.lit(b).alias("m1")) for t, (a, b) in enumerate(masks.view(np.int64).tolist())])
    keyed = codes.select("code", "c0", "c1", F.explode(tables).alias("p"))
    keyed = keyed.select("code", "c0", "c1", "p.t", F.xxhash64("p.t", F.col("c0").bitwiseAND(F.col("p.m0")), F.col("c1").bitwiseAND(F.col("p.m1"))).alias("key"))
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    total = codes.count() * len(masks)
    parts = F.ceil(F.col("n") / CODES)
    dealt = attach(keyed, sizes, "key", "n", total).filter("n > 1").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "code"), parts))
    other = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    met = dealt.withColumn("to", other).groupBy("key", "t", F.least("part", "to").alias("lo"), F.greatest("part", "to").alias("hi"))
    met = met.agg(F.collect_list(F.struct("part", "code", "c0", "c1")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(np.empty(0, np.int64),) * 2]
            tables, los, his = (b.column(c).to_pylist() for c in ("t", "lo", "hi"))
            rows = b.column("rows")
            own = {n: rows.flatten().field(n).to_numpy() for n in ("part", "code", "c0", "c1")}
            ends = np.concatenate(([0], np.cumsum(rows.value_lengths().to_numpy())))
            for k, (t, lo, hi) in enumerate(zip(tables, los, his, strict=True)):
                part, code, c0, c1 = (own[n][ends[k] : ends[k + 1]] for n in ("part", "code", "c0", "c1"))
                left, right = (np.flatnonzero(part == x) for x in (lo, hi))
                for s in range(0, len(left), 512):
                    i, j = left[s : s + 512, None], right[None, :]
                    x0, x1 = ((c[i] ^ c[j]).view(np.uint64) for c in (c0, c1))
                    near = (np.bitwise_count(x0) + np.bitwise_count(x1) <= most) & ((i < j) if lo == hi else True)
                    x0, x1, (p, q) = x0[near], x1[near], np.nonzero(near)
                    if t and len(p):
                        new = np.ones(len(p), bool)
                        for m0, m1 in masks[:t]:
                            new &= (x0 & m0 | x1 & m1) != 0
                        p, q = p[new], q[new]
                    out.append((code[left[s + p]], code[right[q]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b"])

    return met.select("t", "lo", "hi", "rows").mapInArrow(run, "a bigint, b bigint")


def _links(
    x_cid: np.ndarray, x_ids: np.ndarray, x: np.ndarray, x_size: np.ndarray, y_cid: np.ndarray, y_ids: np.ndarray, y: np.ndarray, y_size: np.ndarray, same: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their ids, numbers of links and least linked ids, of two blocks of classes with so many members."""
    near = x @ y.T >= threshold
    near &= x_ids[:, None] != y_ids[None, :]
    if not near.any():
        return (np.empty(0, np.int64),) * 4
    left, right = x_ids.copy(), y_ids.copy()
    top = np.iinfo(np.int64).max
    while True:  # least id reachable inside the two blocks
        a = np.minimum(left, np.where(near, right[None, :], top).min(axis=1))
        b = np.minimum(right, np.where(near, a[:, None], top).min(axis=0))
        if same:
            a = b = np.minimum(a, b)
        if (a == left).all() and (b == right).all():
            break
        left, right = a, b
    n_x, n_y = near @ y_size, x_size @ near
    keep_x, keep_y = n_x > 0, n_y > 0
    if same:
        return x_cid[keep_x], x_ids[keep_x], n_x[keep_x], left[keep_x]
    return np.r_[x_cid[keep_x], y_cid[keep_y]], np.r_[x_ids[keep_x], y_ids[keep_y]], np.r_[n_x[keep_x], n_y[keep_y]], np.r_[left[keep_x], right[keep_y]]


def _linked(good: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, n, root) of usable (id, v) of one length: numbers of links and least linked ids, part by part.

    All tables here grow with the vectors, so their joins are hinted: Spark would broadcast those whose files
    seem small, and the driver holds several times as much as the files of each.
    """
    index = fitted(good, n, threshold)
    every_pair = index.share < RECALL
    if every_pair:
        warnings.warn(f"{len(index.masks)} tables for {n} vectors would find {index.share:.2f} of the pairs at {threshold}: all vectors are compared in blocks", RuntimeWarning, stacklevel=2)
    vectors = written(encode(good, index).withColumn("same", F.md5("vec")), "codes")
    # an id with several vectors does not link with itself: each of its rows is a class of its own
    torn = vectors.groupBy("id").agg(F.min("same").alias("lo"), F.max("same").alias("hi")).filter("lo <> hi").select("id", F.col("id").alias("alone"))
    torn = written(torn, "torn-ids")
    vectors = vectors.withColumn("alone", F.lit(None).cast("long")) if torn.isEmpty() else vectors.join(torn.hint("merge"), "id", "left")
    vectors = vectors.withColumn("class", F.concat_ws("|", "same", "alone")).drop("same", "alone")
    first = [F.first(c).alias(c) for c in ("c0", "c1", "vec")]
    classes = vectors.groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("size"), *first)
    wide = max(1, math.ceil(n / WIDE_BLOCK))
    code = F.pmod(F.xxhash64(F.lit("block"), "class"), F.lit(wide).cast("long")) if every_pair else F.xxhash64("c0", "c1")
    classes = written(classes.withColumns({"code": code, "cid": F.xxhash64("class")}), "vector-classes")
    codes = classes.groupBy("code").agg(F.first("c0").alias("c0"), F.first("c1").alias("c1"), F.count("*").alias("n"))
    codes = written(codes.withColumn("blocks", F.ceil(F.col("n") / (2 * WIDE_BLOCK if every_pair else BLOCK))), "code-sizes")
    placed = attach(classes, codes.select("code", "n", "blocks"), "code", "n", n).withColumn("sub", F.pmod(F.xxhash64("class"), F.col("blocks")))
    blocks = written(placed.groupBy("code", "sub").agg(F.collect_list(F.struct("cid", "rep", "size", "vec")).alias("rows")), "blocks")

    every = codes.select("code", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("sub"))
    several = every.filter("n > 1")
    inside = several.alias("x").join(several.alias("y").hint("merge"), "code").filter("x.sub <= y.sub")
    inside = inside.select(F.col("code").alias("a"), F.col("x.sub").alias("sa"), F.col("code").alias("b"), F.col("y.sub").alias("sb"))
    if every_pair:  # the later blocks of every block
        numbers = good.sparkSession.range(wide - 1).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.lit(wide - 1).cast("long"))).alias("b"))
        pairs = numbers.repartition("a", "b")
    else:
        pairs = written(near_codes(codes.select("code", "c0", "c1"), index.masks, index.most), "code-pairs")
    x, y = (every.select(F.col("code").alias(s), F.col("sub").alias(f"s{s}")) for s in "ab")
    across = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "sa", "b", "sb")
    x, y = (blocks.select(F.col("code").alias(s), F.col("sub").alias(f"s{s}"), F.col("rows").alias(f"r{s}")) for s in "ab")
    work = inside.unionByName(across).join(x.hint("merge"), ["a", "sa"]).join(y.hint("merge"), ["b", "sb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.empty(0, np.int64),) * 4]
            keys = [batch.column(c).to_pylist() for c in ("a", "sa", "b", "sb")]
            sides = []
            for s in "ab":
                rows = batch.column(f"r{s}")
                raw = rows.flatten().field("vec")
                vec = np.frombuffer(b"".join(raw.to_pylist()), float).reshape(len(raw), -1)
                sides.append((rows.flatten().field("cid").to_numpy(), rows.flatten().field("rep").to_numpy(), vec, rows.flatten().field("size").to_numpy(), np.concatenate(([0], np.cumsum(rows.value_lengths().to_numpy())))))
            for k, (a, sa, b, sb) in enumerate(zip(*keys, strict=True)):
                own = [x[ends[k] : ends[k + 1]] for *side, ends in sides for x in side]
                out.append(_links(*own, same=(a, sa) == (b, sb), threshold=threshold))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["cid", "rep", "n", "root"])

    found = written(work.select("a", "sa", "b", "sb", "ra", "rb").mapInArrow(run, "cid bigint, rep bigint, n bigint, root bigint"), "links")
    sums = found.groupBy("cid", "rep").agg(F.sum("n").alias("links"))  # an id's several vectors are classes of one rep, each with its own links
    of_class = written(classes.select("class", "cid", "rep", "size").join(sums.hint("merge"), ["cid", "rep"], "left").drop("cid").filter("size > 1 or links > 0"), "class-links")
    members = vectors.groupBy("id", "class").agg(F.count("*").alias("rows"))
    met = attach(members, of_class, "class", "size", n).filter("rep is not null")
    own = met.select("id", (F.col("rows") * (F.coalesce("links", F.lit(0)) + F.col("size") - F.col("rows"))).alias("n"), F.col("rep").alias("root"))
    # every edge between classes, one row a representative and block
    return written(own.unionByName(found.select(F.col("rep").alias("id"), F.lit(0).cast("long").alias("n"), "root")), "vector-links")


def link(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row.

    Links are the pairs found with cosine >= threshold; n_links counts a
    vector's links, component_id is the smallest id reachable. Vectors that are
    null, zero, or hold null or non-finite components, and null ids link with
    nothing: 0 links, their own component. Vectors link with those of their own
    length; each length is a run of its own. Rows that repeat an id and its
    vector count once; rows that repeat an id with other vectors never link with
    each other and share the sum of their links. An empty table gives no rows.
    Other columns are not read.
    """
    own = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = own.filter(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("d").collect()
    parts = [_linked(good.filter(F.size("v") == r["d"]), r["n"], threshold) for r in lengths]
    found = reduce(DataFrame.unionByName, parts) if parts else embeddings.sparkSession.createDataFrame([], "id bigint, n bigint, root bigint")
    reach = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("n_links")).join(reach.hint("merge"), F.col("id") == F.col("node"), "left").drop("node")
    out = own.select("id").join(counts.hint("merge"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
