"""Packing documents into sequences: bounded-space online best-fit.

Pieces arrive in the order of a hash, at a packer each takes its share. A packer
keeps a fixed number of open bins, found through a bitset keyed by free space:
a piece goes to the open bin with the least space that holds it; if none does
and all places are taken, the fullest bin closes and a new one opens.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoded_pieces, tokenizer_path

SEQUENCE = 2048
OPEN_BINS = 512
#: Pieces for one packer: each leaves up to OPEN_BINS bins part empty, so their
#: number follows the pieces and the waste stays a constant small share.
PIECES_PER_PACKER = 150_000


class BestFit:
    """place(length) -> (bin, offset) with at most `open_bins` bins open."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most, self.n_open, self.bins = size, open_bins, 0, 0
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free space
        self.bits = 0  # bit f is set when free[f] is not empty

    def _take(self, space: int) -> int:
        own = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        return own

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            own = self._take(space)
            self.n_open -= 1
        else:
            if self.n_open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            own, space = self.bins, self.size
            self.bins += 1
        if space > length:  # a full bin closes at once
            rest = space - length
            self.free[rest].append(own)
            self.bits |= 1 << rest
            self.n_open += 1
        return own, self.size - space


def pack(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Adds (sequence_id, offset) to pieces (id, piece, start, length, ids_crc32).

    Lengths are 1 to size. Every piece is placed whole; sequences are filled
    without gaps. Ties and repeated rows are placed one by one. An empty table
    gives no rows. The number of packers follows the number of pieces.
    """
    own = written(pieces, "pieces")
    packers = max(1, math.ceil(own.count() / per_packer))
    keyed = own.withColumn("h", F.xxhash64("id", "piece", "ids_crc32")).withColumn("packer", F.pmod("h", F.lit(packers)))
    id_type = own.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort([table.column(c).to_numpy(zero_copy_only=False) for c in ("start", "ids_crc32", "h")])
        table = table.take(pa.array(order))
        fit, base = BestFit(size, open_bins), table.column("packer")[0].as_py() << 40
        at = [fit.place(n) for n in table.column("length").to_pylist()]
        return (
            table.drop_columns(["h", "packer"])
            .append_column("sequence_id", pa.array([base + b for b, _ in at], pa.int64()))
            .append_column("offset", pa.array([o for _, o in at], pa.int64()))
        )

    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return keyed.groupBy("packer").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """documents as pieces with their places in sequences of at most size tokens.

    Returns (id, piece, start, length, ids_crc32, sequence_id, offset). A null
    or empty text is the end token alone; only documents longer than a sequence
    are cut. Rows that repeat an id are packed each. Other columns are not read.
    """
    return pack(encoded_pieces(docs, "doc_id", "text", path or tokenizer_path("word_bpe_49k.json"), size), size, open_bins)


def sequences(docs: DataFrame, placed: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """The sequences' token ids, (sequence_id, ids array), from documents with unique ids."""
    with_ids = encoded_pieces(docs, "doc_id", "text", path or tokenizer_path("word_bpe_49k.json"), size, with_ids=True)
    parts = with_ids.select("id", "piece", "ids").join(placed.select("id", "piece", "sequence_id", "offset"), ["id", "piece"])
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    raw = F.expr("aggregate(parts, cast('' as binary), (s, x) -> s || x.ids)")

    def run(batches):
        for b in batches:
            ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in b.column("raw").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), ids], ["sequence_id", "ids"])

    return joined.select("sequence_id", raw.alias("raw")).mapInArrow(run, "sequence_id bigint, ids array<int>")
