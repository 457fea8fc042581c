"""Exact deduplication: binary-fuse filters over immutable snapshots.

The corpus arrives in batches. Each batch is grouped by digest on its own; its
distinct digests are screened against one static binary-fuse filter per
earlier, immutable snapshot; the positives alone join the exact digest buckets
of that snapshot, where the texts' bytes are compared, and take that snapshot's
class. Digests that no snapshot holds make the batch's own snapshot and classes
of their own; nothing else groups the batches.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, kept_once, squeezed, written

#: Digests in one filter; a snapshot has as many filters as that takes.
KEYS_PER_FILTER = 32_768


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class FuseFilter:
    """Static 3-wise binary-fuse filter (Graf and Lemire, 2022), 16-bit fingerprints.

    The three cells of a key lie in three consecutive segments. Built by peeling
    in rounds, each round vectorised; a key that is in the set always tests
    positive, another with probability 2**-16.
    """

    def __init__(self, seed: int, bits: int, segments: int, cells: np.ndarray):
        self.seed, self.bits, self.segments, self.cells = seed, bits, segments, cells

    @staticmethod
    def _places(h: np.ndarray, bits: int, segments: int) -> np.ndarray:
        first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        mask = np.uint64((1 << bits) - 1)
        inside = (h & mask, (h >> np.uint64(18)) & mask, (h >> np.uint64(36)) & mask)
        return np.stack([((first + np.uint64(j)) << np.uint64(bits)) + x for j, x in enumerate(inside)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = max(2, len(keys))
        bits = min(17, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) + 8
        segments = max(1, math.ceil(room / (1 << bits)) - 2)
        for attempt in range(200):
            if attempt % 20 == 19:
                segments += 1
            order = cls._peel(h := _mix(keys, 0x9E3779B97F4A7C15 * (attempt + 1)), bits, segments)
            if order is not None:
                break
        else:
            raise RuntimeError("binary-fuse filter: peeling failed")
        places = cls._places(h, bits, segments)
        cells, print_ = np.zeros((segments + 2) << bits, np.uint16), cls._print(h)
        for ids, own in reversed(order):
            at = places[:, ids]
            value = print_[ids] ^ cells[at[0]] ^ cells[at[1]] ^ cells[at[2]]
            cells[at[own, np.arange(len(ids))]] = value  # the own cell was still 0
        return cls(0x9E3779B97F4A7C15 * (attempt + 1), bits, segments, cells)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint16)

    @classmethod
    def _peel(cls, h: np.ndarray, bits: int, segments: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, which of their cells they own), or None if some keys stay."""
        n, size, places = len(h), (segments + 2) << bits, cls._places(h, bits, segments)
        count = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # XOR of the keys in each cell
        for row in places:
            np.bitwise_xor.at(held, row, np.arange(n))
        order, left, front = [], n, np.flatnonzero(count == 1)
        while len(front):
            ids, first = np.unique(held[front], return_index=True)
            cells = front[first]
            own = np.argmax(places[:, ids] == cells, axis=0)
            order.append((ids, own))
            left -= len(ids)
            touched = places[:, ids].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(held, touched, np.tile(ids, 3))
            touched = np.unique(touched)
            front = touched[count[touched] == 1]
        return order if left == 0 else None

    def has(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64), self.seed)
        at = self._places(h, self.bits, self.segments)
        return self._print(h) == self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]


def _key(digest: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digest), "<u8") if len(digest) else np.empty(0, np.uint64)


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter a bucket of the snapshot's distinct digests: (bucket, seed, bits, segments, cells)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(_key(pdf["digest"]))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": [str(f.seed)], "bits": f.bits, "segments": f.segments, "cells": [f.cells.tobytes()]})

    return (
        snapshot.select(_bucket(buckets).alias("bucket"), "digest")
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, seed string, bits int, segments int, cells binary")
    )


def _bucket(buckets: int):
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % buckets).cast("int")


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The digests that a snapshot's filters do not exclude."""

    def test(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(kept):
            return own[["digest"]].iloc[:0]
        f = kept.iloc[0]
        fuse = FuseFilter(int(f["seed"]), int(f["bits"]), int(f["segments"]), np.frombuffer(f["cells"], np.uint16))
        return own.loc[fuse.has(_key(own["digest"])), ["digest"]]

    left = digests.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInPandas(test, "digest binary")


def digest_rows(docs: DataFrame, id_col: str, text_col: str, batch: Column) -> DataFrame:
    norm = squeezed(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
        batch.alias("batch"),
    )


def exact_dedup(docs: DataFrame, batch: Column, n_batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups all rows by equal normalised text; batch numbers a row's batch from 0 in order of arrival.

    Returns (id, digest, keep_id, group_size, kept), one row per input row. Two
    texts are equal when they are identical without white space; a null text is
    an empty text, and all empty texts are one group. Of a group the row with
    most code points stays, then the smallest id (null before all). Rows that
    repeat an id share its verdict. An empty table gives no rows. Columns other
    than the named ones are not read, so their names cannot clash.

    Raises if a batch's text and the earlier snapshot's text with its SHA-256
    digest differ in their bytes.
    """
    facts = written(digest_rows(docs, id_col, text_col, batch), "digests")
    best = F.min(F.struct((-F.col("points")).alias("neg"), F.col("id"))).alias("best")
    grouped = written(facts.groupBy("batch", "digest").agg(best, F.count("*").alias("n")), "batch-groups")
    snapshots: list[tuple[DataFrame, DataFrame, int]] = []
    pairs, members = [], []  # members: (batch, digest, best, n, home), home being the snapshot whose class it is
    for k in range(n_batches):
        fresh = grouped.filter(F.col("batch") == k)
        for home, (old, filters, buckets) in enumerate(snapshots):
            maybe = screen(fresh, filters, buckets)
            sure = maybe.join(old.select("digest", F.col("best.id").alias("other")), "digest").join(fresh, "digest")
            sure = written(sure.select("batch", "digest", "best", "n", F.lit(home).alias("home"), "other"), "positives")
            pairs.append(sure.select("digest", "best.id", "other"))
            members.append(sure.drop("other"))
            fresh = fresh.join(sure.select("digest"), "digest", "left_anti")
        fresh = written(fresh.select("batch", "digest", "best", "n", F.lit(k).alias("home")), "snapshot")
        members.append(fresh)
        if k < n_batches - 1:  # the last batch is not a snapshot for any other
            buckets = max(1, math.ceil(fresh.count() / KEYS_PER_FILTER))
            snapshots.append((fresh, written(build_filters(fresh, buckets), "filters"), buckets))
    if pairs:
        _check_bytes(docs, reduce(DataFrame.unionByName, pairs), id_col, text_col)
    members = reduce(DataFrame.unionByName, members)
    totals = members.groupBy("digest", "home").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    classes = written(members.drop("best").join(totals, ["digest", "home"]).drop("home"), "classes")
    return attach(facts, classes, ["batch", "digest"], "n", facts.count()).select(
        "id", "digest", F.col("best.id").alias("keep_id"), "group_size", F.col("id").eqNullSafe(F.col("best.id")).alias("kept")
    )


def _check_bytes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> None:
    """Compares the normalised bytes of both sides of every positive, those with a null id too."""
    wanted = pairs.select("digest", F.explode(F.array("id", "other")).alias("id")).distinct()
    norm = squeezed(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("own_id"), F.unhex(F.sha2(norm, 256)).alias("own_digest"), norm.alias("norm"))
    # always dealt by id and digest: a broadcast below some size would make the cost jump there
    met = texts.hint("merge").join(wanted, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_digest") == F.col("digest")))
    bad = met.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).filter("lo <> hi")
    if not bad.isEmpty():
        raise RuntimeError("two different texts share a SHA-256 digest")


#: Arrivals of a table that is deduplicated in one go.
N_BATCHES = 3


def arrival(id_col: str = "doc_id") -> Column:
    """Deals rows to two snapshots and an incoming batch by the id's CRC-32: half, a quarter, a quarter."""
    part = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4
    return F.greatest(part - 1, F.lit(0)).cast("int")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns as they were; of rows that repeat an id and its text, one."""
    found = exact_dedup(docs, arrival(), N_BATCHES).filter("kept")
    digest = F.unhex(F.sha2(squeezed(docs["text"]), 256))
    return kept_once(docs, [docs["doc_id"], digest], found.select("id", "digest"))
