"""Hard negatives by an inverted multi-index (Babenko and Lempitsky, 2012).

The halves of all vectors get a codebook each, learnt on a bounded sample; a pair
of codewords is a cell. For an anchor, the inner product with a half of any
vector of a codeword is at most its product with the codeword plus its own length
times the codeword's radius. A heap visits the cells by the sum of both half
bounds, downwards. Cells are visited in two rounds: the first ones until they
hold FIRST rows; then all whose bound reaches what the first ones left open. A
window of scores is certified once no cell left can hold a row of it that would
come before the ones found, so results are exact whatever the codebooks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows on which the codebooks are learnt; codewords of a half at most, so that a list of all cells has a proven bound.
SAMPLE, WORDS = 10_000, 128
#: Rows of a cell and of a shard of cells, and anchors that meet a shard together, about.
CELL_ROWS, SHARD_ROWS, ANCHORS = 200, 2048, 512
#: Rows of the cells that are visited first.
FIRST = 2000
ITERATIONS = 12


def learn_codebook(x: np.ndarray, words: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Centres of the rows of x by Lloyd's iteration, from evenly spaced rows; at most as many as there are rows."""
    centres = x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)].astype(float)
    for _ in range(iterations):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


@dataclass
class Cells:
    """Codebooks of both halves; of every occupied cell (i, j): rows, radii of the halves, its first shard and its number of shards."""

    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    radii: np.ndarray
    shard: np.ndarray
    parts: np.ndarray

    def visit(self, q: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound of all cells from here on, least score that the cell can hold, cell), by multi-sequence."""
        h, words = self.left.shape[1], len(self.right)
        occupied = self.rows > 0
        bounds, products, lengths = [], [], []
        for centres, part, r, axis in ((self.left, q[:h], self.radii[0], 1), (self.right, q[h:], self.radii[1], 0)):
            length = float(np.sqrt(part @ part))
            product = centres @ part
            widest = np.where(occupied, r, 0).max(axis=axis)
            bounds.append(np.where(occupied.any(axis=axis), product + length * widest, -np.inf))
            products.append(product)
            lengths.append(length)
        order = [np.argsort(-b, kind="stable") for b in bounds]
        u, v = (b[o].tolist() for b, o in zip(bounds, order, strict=True))
        slack = 1 + 1e-9 * float(np.sqrt(q @ q)) * max(1.0, float(np.abs(u[0])), float(np.abs(v[0])))
        heap, done = [(-(u[0] + v[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            if bound == np.inf:
                return
            x, y = int(order[0][i]), int(order[1][j])
            if occupied[x, y]:
                least = products[0][x] + products[1][y] - lengths[0] * self.radii[0, x, y] - lengths[1] * self.radii[1, x, y]
                yield -bound + slack, float(least) - slack, x * words + y
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(u) and b < len(v) and (a, b) not in done:
                    done.add((a, b))
                    heapq.heappush(heap, (-(u[a] + v[b]), a, b))


def _matrix(column: pa.ChunkedArray | pa.Array, d: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), d).astype(kind)


def fitted(rows: DataFrame, n: int, d: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Learns both codebooks in one task, on at most `sample` rows by a hash of the row; the driver gets the codebooks alone."""
    words, half = max(1, min(WORDS, round(math.sqrt(n / CELL_ROWS)))), d // 2
    near = rows.withColumn("g", F.xxhash64(F.lit("codebook"), "id", "h")).filter(F.pmod("g", F.lit(1 << 30)) < float(1 << 30) * min(1.0, 2 * sample / max(n, 1)))

    def solve(t: pa.Table) -> pa.Table:
        x = _matrix(t.sort_by([("g", "ascending"), ("id", "ascending")]).column("x"), d)
        return pa.table([pa.array([learn_codebook(part, words).tobytes()], pa.binary()) for part in (x[:, :half], x[:, half:])], ["a", "b"])

    got = near.orderBy("g", "id").limit(sample).select("g", "id", "x").groupBy(F.lit("codebooks")).applyInArrow(solve, "a binary, b binary").first()
    if got is None:  # the hash took none of few rows
        return np.zeros((1, half)), np.zeros((1, d - half))
    k = max(1, len(got["b"]) // (8 * max(1, d - half)))
    return np.frombuffer(got["a"]).reshape(-1 if half else k, half), np.frombuffer(got["b"]).reshape(-1 if d > half else k, d - half)


def indexed(rows: DataFrame, n: int, d: int) -> tuple[DataFrame, Cells]:
    """(id, h, label, x, cell, shard) of all rows, written, and the list of cells."""
    left, right = fitted(rows, n, d)
    half = d // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x, out = _matrix(part.column("x"), d), []
                for centres, own in ((left, x[:, :half]), (right, x[:, half:])):
                    at = nearest(own, centres)
                    off = own - centres[at]
                    out.append((at, np.sqrt((off * off).sum(axis=1))))
                cell = out[0][0] * len(right) + out[1][0]
                cols = [part.column(c) for c in ("id", "h", "label", "x")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(cell.astype(np.int32)), pa.array(out[0][1]), pa.array(out[1][1])], ["id", "h", "label", "x", "cell", "e0", "e1"])

    placed = written(rows.select("id", "h", "label", "x").mapInArrow(place, "id bigint, h bigint, label string, x binary, cell int, e0 double, e1 double"), "placed-vectors")
    shape = (len(left), len(right))
    count, radii = np.zeros(shape, np.int64), np.zeros((2, *shape))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("e0").alias("e0"), F.max("e1").alias("e1")).collect():  # WORDS * WORDS rows at most
        count.flat[r["cell"]] = r["n"]
        radii[0].flat[r["cell"]], radii[1].flat[r["cell"]] = r["e0"], r["e1"]
    parts = np.maximum(1, -(-count // SHARD_ROWS))
    shard, room = np.zeros(shape, np.int64), [0, 0]  # the next shard's number, and the rows of the open one
    for c in np.flatnonzero(count.ravel()):
        m = int(count.flat[c])
        if room[1] and room[1] + m > SHARD_ROWS:
            room = [room[0] + 1, 0]
        shard.flat[c] = room[0]
        room = [room[0], room[1] + m] if parts.flat[c] == 1 else [room[0] + int(parts.flat[c]), 0]
    cells = Cells(left, right, count, radii, shard, parts)
    table = placed.sparkSession.createDataFrame(
        [(int(c), int(shard.flat[c]), int(parts.flat[c])) for c in np.flatnonzero(count.ravel())], "cell int, first long, parts long"
    )
    dealt = placed.join(F.broadcast(table), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id", "h"), F.col("parts")))
    return written(dealt.select("id", "h", "label", "x", "cell", "shard"), "sharded-vectors"), cells


def _first(score: np.ndarray, fine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first k fine entries of every row, by score downwards, then id."""
    least = np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf
    s = np.where(fine, score, least)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        fine = fine & (s >= kth[:, None])
    i, j = np.nonzero(fine)
    order = np.lexsort((ids[j], -s[i, j], i))
    i, j = i[order], j[order]
    starts = np.searchsorted(i, np.arange(len(s)))
    keep = np.arange(len(i)) - starts[i] < k
    return i[keep], j[keep]


def _searched(queries: DataFrame, vectors: DataFrame, cells: Cells, d: int, k: int, same: bool, n_blocks: int, kind: type) -> DataFrame:
    """(id, h, w, row_id, row_h, score): the first k rows of every window of every query, exact.

    queries: (id, h, label, x, los array<long>, his array<long>), a window each
    with lo <= score <= hi; rows of the query's own id take no part.
    """

    def route(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list = []
                los, his = b.column("los").to_pylist(), b.column("his").to_pylist()
                for r, q in enumerate(_matrix(b.column("x"), d)):
                    open_ = [(lo, hi) for lo, hi in zip(los[r], his[r], strict=True) if lo <= hi]
                    if not open_:
                        continue
                    low, high, seen, visits = min(lo for lo, _ in open_), max(hi for _, hi in open_), 0, {}
                    for bound, least, cell in cells.visit(q):
                        late, seen = seen >= FIRST, seen + int(cells.rows.flat[cell])
                        if bound < low or (late and not again):
                            break
                        if late == again and least <= high:
                            for p in range(int(cells.parts.flat[cell])):
                                visits.setdefault(int(cells.shard.flat[cell]) + p, []).append(cell)
                    out += [(r, s, c) for s, c in visits.items()]
                at = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(at) for c in ("id", "h", "label", "x", "los", "his", "block")), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))],
                    ["id", "h", "label", "x", "los", "his", "block", "shard", "cells"],
                )

        return run

    def meet(visits: pa.Table, rows: pa.Table) -> pa.Table:
        x, cell, ids = _matrix(rows.column("x"), d, kind), rows.column("cell").to_numpy(), rows.column("id").to_numpy()
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        x, ids, hs = x[order], ids[order], rows.column("h").to_numpy()[order]
        names, label = np.unique(np.array([*rows.column("label").to_pylist(), *visits.column("label").to_pylist()]), return_inverse=True)
        mine, label = label[len(order) :], label[: len(order)][order]
        a, a_ids, a_hs = _matrix(visits.column("x"), d, kind), visits.column("id").to_numpy(), visits.column("h").to_numpy()
        los, his, wanted = (visits.column(c).to_pylist() for c in ("los", "his", "cells"))
        out = []
        for s in range(0, len(a), 128):
            own = slice(s, min(s + 128, len(a)))
            score, seen = np.zeros((own.stop - s, len(x)), kind), np.zeros((own.stop - s, len(x)), bool)
            by_cell: dict[int, list[int]] = {}
            for r in range(own.start, own.stop):
                for c in wanted[r]:
                    by_cell.setdefault(c, []).append(r - s)
            for c, who in by_cell.items():
                lo, hi = np.searchsorted(cell, [c, c + 1])
                score[who, lo:hi] = a[own][who] @ x[lo:hi].T
                seen[who, lo:hi] = True
            seen &= (label[None, :] == mine[own, None]) == same
            seen &= ids[None, :] != a_ids[own, None]
            for w in range(max(len(los[r]) for r in range(own.start, own.stop))):
                with_w = np.array([len(los[r]) > w for r in range(own.start, own.stop)])
                lo, hi = (np.array([v[r][w] if len(v[r]) > w else 0 for r in range(own.start, own.stop)])[:, None] for v in (los, his))
                i, j = _first(score, seen & with_w[:, None] & (score >= lo) & (score <= hi), ids, k)
                out.append((a_ids[own][i], a_hs[own][i], np.full(len(i), w), ids[j], hs[j], score[i, j]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0)] * 6
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], ["id", "h", "w", "row_id", "row_h", "score"]).set_column(2, "w", pa.array(cols[2].astype(np.int32)))

    routed = "id bigint, h bigint, label string, x binary, los array<bigint>, his array<bigint>, block bigint, shard bigint, cells array<int>"
    first_k = Window.partitionBy("id", "h", "w").orderBy(F.col("score").desc(), "row_id", "row_h")

    def round_of(own: DataFrame, again: bool) -> DataFrame:
        own = own.withColumn("block", F.pmod(F.xxhash64("id", "h"), F.lit(n_blocks).cast("long")))
        visits = written(own.select("id", "h", "label", "x", "los", "his", "block").mapInArrow(route(again), routed), "visits")
        asked = visits.select("shard", F.col("block").alias("by")).distinct()
        sent = vectors.join(asked, "shard").select(F.col("shard").alias("at"), "by", "id", "h", "label", "x", "cell")
        return visits.groupBy("shard", "block").cogroup(sent.groupBy("at", "by")).applyInArrow(meet, "id bigint, h bigint, w int, row_id bigint, row_h bigint, score bigint")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("_n", F.row_number().over(first_k)).filter(F.col("_n") <= k).drop("_n")

    one = written(best(round_of(queries, False)), "windows-first")
    full = one.groupBy("id", "h", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
    full = full.groupBy("id", "h").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
    closer = F.transform("los", lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("kth", w), lo)))
    two = round_of(queries.join(full, ["id", "h"], "left").withColumn("los", F.when(F.col("kth").isNull(), F.col("los")).otherwise(closer)).drop("kth"), True)
    return written(best(one.unionByName(two)), "windows")


def usable(vector: Column) -> Column:
    """Not null, without a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label", positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every anchor and each of its first
    `positives` rows of its label, the first `negatives` rows of other labels whose score is least to most percent of the positive's.

    rows: an id, a label and a vector of whole numbers; anchor: a condition on the
    columns of rows. Scores are exact inner products; higher come first, then smaller
    ids. Rows with a null id, label, vector or component take no part. Rows that repeat an id,
    label and vector count once; others that repeat an id are rows (and anchors) of
    their own, but never positives or negatives of their own id. Vectors score with
    those of their own length, each length is a run of its own. Scores that do not fit a long
    are an error. No rows, no anchors or no rows of another label give no rows. Other columns are not read.
    """
    own = rows.withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"), "_anchor")
    own = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
    own = written(own.withColumn("h", F.xxhash64("label", "v")).dropDuplicates(["id", "h"]), "vectors")
    size = F.coalesce(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))), F.lit(0)).alias("most")
    lengths = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("_anchor").cast("long")).alias("anchors"), size).orderBy("d").collect()
    parts = []
    for r in lengths:
        if r["n"] < 2 or not r["anchors"]:
            continue
        if (top := int(r["most"]) ** 2 * max(1, r["d"])) >= 1 << 62:
            raise ValueError(f"inner products of vectors of {r['d']} components up to {r['most']} do not fit a long")
        parts.append(_mined(own.filter(F.size("v") == r["d"]), r, positives, negatives, least, most, np.float64 if top < 1 << 53 else np.int64))
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, parts)


def _bytes(own: DataFrame) -> DataFrame:
    """own with x, the vector's numbers as bytes, instead of v."""
    rest = [c for c in own.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([r.tobytes() for r in x], pa.binary())], [*rest, "x"])

    types = dict(own.dtypes)
    return own.select(*rest, F.col("v").cast("array<bigint>").alias("v")).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in rest) + ", x binary")


def _div(percent: Column) -> Column:
    """A hundredth of a long, cut off towards zero."""
    return F.call_function("div", percent, F.lit(100).cast("long"))


def _mined(own: DataFrame, r, positives: int, negatives: int, least: int, most: int, kind: type) -> DataFrame:
    rows, d = _bytes(own), r["d"]
    vectors, cells = indexed(rows, r["n"], d)
    n_blocks = math.ceil(r["anchors"] / ANCHORS)
    all_scores = [F.array(F.lit(e).cast("long")).alias(c) for e, c in ((-(1 << 62), "los"), (1 << 62, "his"))]
    anchors = written(rows.filter("_anchor").select("id", "h", "label", "x", *all_scores), "anchors")
    near = _searched(anchors, vectors, cells, d, positives, True, n_blocks, kind)
    order = Window.partitionBy("id", "h").orderBy(F.col("score").desc(), "row_id", "row_h")
    near = written(near.select("id", "h", "row_id", "score", (F.row_number().over(order) - 1).alias("w")), "positives")
    low, high = F.col("score") * least, F.col("score") * most  # whole percents: rounded inwards without fractions
    lo = F.when(low > 0, low + 99).otherwise(low)
    hi = F.when(high < 0, high - 99).otherwise(high)
    ends = F.struct("w", _div(lo).alias("lo"), _div(hi).alias("hi"))
    windows = near.groupBy("id", "h").agg(F.sort_array(F.collect_list(ends)).alias("a"))
    windows = windows.select("id", "h", F.col("a.lo").alias("los"), F.col("a.hi").alias("his"))
    asked = written(anchors.drop("los", "his").join(windows, ["id", "h"]), "windows-asked")
    got = _searched(asked, vectors, cells, d, negatives, False, n_blocks, kind)
    rank = F.row_number().over(Window.partitionBy("id", "h", "w").orderBy(F.col("score").desc(), "row_id", "row_h"))
    named = near.select("id", "h", "w", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return got.withColumn("rank", rank).join(named, ["id", "h", "w"]).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
