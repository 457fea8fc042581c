"""Image features: random patch filters, convolution features, pixel predictions.

images: (id, x ARRAY<FLOAT>) with x of size channels * size * size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rng import digits
from ..stored import stored


def scale_tail_features(x: Column, n: int, ratio: float) -> Column:
    """The last n features times the square root of ratio."""
    return F.transform(x, lambda v, i: F.when(i >= F.size(x) - n, v * F.sqrt(F.lit(float(ratio)))).otherwise(v))


def _windows(image: np.ndarray, size: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(image, (size, size), axis=(1, 2))


def random_patches(images: DataFrame, n: int, patch: int, size: int, channels: int, seed: str) -> DataFrame:
    """(place, p): n patches at random positions of all images; n bounds the result.

    Every position of every image is a candidate; the n of least hash are taken.
    """
    side = size - patch + 1
    spots = images.select("id", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("pos"))
    chosen = spots.orderBy(digits(seed, F.concat_ws("|", "id", "pos")), "id", "pos").limit(n)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, pos in zip(b["x"], b["pos"], strict=True):
                r, c = divmod(int(pos), side)
                out.append(np.asarray(x, float).reshape(channels, size, size)[:, r : r + patch, c : c + patch].ravel().tolist())
            yield pd.DataFrame({"id": b["id"], "pos": b["pos"], "p": out})

    kind = images.schema["id"].dataType.simpleString()
    return images.join(chosen, "id").select("id", "pos", "x").mapInPandas(cut, f"id {kind}, pos int, p array<double>")


def normed(patches: np.ndarray) -> np.ndarray:
    """Patches less their own mean, of unit norm (norms under 1e-8 count as 1)."""
    p = patches - patches.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(p, axis=1, keepdims=True)
    return p / np.where(norm < 1e-8, 1.0, norm)


def whitening(mean: np.ndarray, cov: np.ndarray, eps: float = 1e-3) -> np.ndarray:
    """The ZCA matrix of a covariance of normed patches: as wide as a patch."""
    values, vectors = np.linalg.eigh(cov - np.outer(mean, mean))
    return (vectors / np.sqrt(np.maximum(values, 0) + eps)) @ vectors.T


def whitened_patches(patches: DataFrame, eps: float = 1e-3) -> DataFrame:
    """patches with p whitened over all of them: means and products are added up in tasks, a matrix as wide as a patch is
    decomposed on the driver, and tasks apply it."""

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return normed(b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            if b.num_rows:
                z = np.column_stack([np.ones(b.num_rows), matrix(b)])
                total = total + z.T @ z
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["one", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(p.as_buffer()) for b in batches for p in b.column("part"))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["one", "part"])

    schema = "one int, part binary"
    salted = patches.select("p").mapInArrow(sums, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    got = salted.groupBy("one", "salt").applyInArrow(add, schema).groupBy("one").applyInArrow(add, schema).first()
    if got is None:
        return patches
    g = np.frombuffer(got["part"])
    g = g.reshape(int(round(len(g) ** 0.5)), -1)
    mean = g[0, 1:] / g[0, 0]
    turn = whitening(mean, g[1:, 1:] / g[0, 0], eps)
    rest = [c for c in patches.columns if c != "p"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(((matrix(b) - mean) @ turn).tolist(), pa.list_(pa.float64()))], [*rest, "p"])

    types = dict(patches.dtypes)
    return patches.select(*rest, "p").mapInArrow(apply, ", ".join([*(f"`{c}` {types[c]}" for c in rest), "p array<double>"]))


def patch_filter_table(images: DataFrame, n: int, patch: int, size: int, channels: int, seed: str) -> DataFrame:
    """(id, pos, p): n whitened random patches, a filter each."""
    return whitened_patches(stored(random_patches(images, n, patch, size, channels, seed), "patches"))


def patch_filters(images: DataFrame, n: int, patch: int, size: int, channels: int, seed: str) -> np.ndarray:
    """n filters of shape (channels, patch, patch) from whitened random patches; n is a parameter and bounds what comes to the driver."""
    rows = patch_filter_table(images, n, patch, size, channels, seed).orderBy("id", "pos").select("p").toArrow().column("p").to_pylist()
    return np.array(rows).reshape(-1, channels, patch, patch)


def noise_filters(n: int, patch: int, channels: int, seed: int, kind: str = "gaussian") -> np.ndarray:
    rng = np.random.default_rng(seed)
    draw = rng.standard_normal if kind == "gaussian" else lambda s: rng.laplace(size=s)
    return draw((n, channels, patch, patch))


def _activations(x: np.ndarray, filters: np.ndarray, bias: float, size: int, channels: int) -> np.ndarray:
    """Maps of relu(conv - bias) and relu(-conv - bias), (2 n, side, side)."""
    conv = np.einsum("chwij,ncij->nhw", _windows(x.reshape(channels, size, size), filters.shape[-1]), filters, optimize=True)
    return np.maximum(np.concatenate([conv, -conv]) - bias, 0)


def random_conv_features(images: DataFrame, filters: np.ndarray, bias: float, size: int, channels: int, pool: int | None = None) -> DataFrame:
    """(id, x): average-pooled activations of every filter and of its negative; pool None averages the whole map."""
    shared = images.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["x"]:
                a = _activations(np.asarray(x, float), shared.value, bias, size, channels)
                w = a.shape[1] if pool is None else pool
                n = a.shape[1] // w
                out.append(a[:, : n * w, : n * w].reshape(len(a), n, w, n, w).mean(axis=(2, 4)).ravel().astype(np.float32).tolist())
            yield pd.DataFrame({"id": b["id"], "x": out})

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "x").mapInPandas(run, f"id {kind}, x array<float>")


def pixel_predictions(images: DataFrame, filters: np.ndarray, weights: np.ndarray, intercept: float, bias: float, size: int, channels: int) -> DataFrame:
    """(tile_id, row, col, pred): the activation maps weighted by a linear model, at every pixel that a whole patch covers."""
    shared = images.sparkSession.sparkContext.broadcast((filters, weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, w = shared.value
        for b in batches:
            for i, x in zip(b["id"], b["x"], strict=True):
                p = np.tensordot(w, _activations(np.asarray(x, float), own, bias, size, channels), axes=1) + intercept
                r, c = np.indices(p.shape)
                yield pd.DataFrame({"tile_id": i, "row": r.ravel(), "col": c.ravel(), "pred": p.ravel()})

    kind = images.schema["id"].dataType.simpleString()
    return images.select("id", "x").mapInPandas(run, f"tile_id {kind}, row int, col int, pred double")
