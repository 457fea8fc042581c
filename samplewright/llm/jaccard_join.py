"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles. Under one global order of the shingles,
rare before frequent, two sets that share enough have common shingles among
their first ones: with a prefix of size - least overlap + m shingles each, at
least m of them. Each document takes its own m from the estimated cost of its
candidates (after Wang, Li and Feng, 2012): a longer prefix is read only where
asking for more matches saves more verification than it costs to read. Two
documents are verified if they share as many prefix shingles as the lesser m.

Equal sets are one class. Documents whose prefixes share their most popular
shingle form bounded blocks; a document meets blocks, not documents, and all
intersections of two blocks are counted inside one task, which only linked
documents leave. So neither copies nor large groups of near copies are expanded
into pairs of rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, components, kept_once, written
from .shingles import sets

#: Counters of the shingle-frequency table that orders shingles; its size is fixed.
COUNTERS = 1 << 20
CHUNK = 1 << 14
#: Shingles of all sets in a block.
BLOCK_SHINGLES = 100_000


def profiles(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, fp) of each (id, text), and the counts of shingles by counter, (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(COUNTERS, np.int64)
        names = ["id", "n", "fp", "chunk", "counts"]
        for b in batches:
            n, fp = [], []
            for own in sets(b.column("text"), k):
                n.append(len(own))
                fp.append(xxhash.xxh3_128_digest(own.tobytes()))
                np.add.at(count, (own & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if count.any():
            parts = range(COUNTERS // CHUNK)
            none = pa.nulls(len(parts))
            counts = [count[p * CHUNK : (p + 1) * CHUNK].astype("<i4") for p in parts]
            counts = [zlib.compress(c.tobytes(), 1) for c in counts]
            yield pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(parts, pa.int32()), pa.array(counts, pa.binary())], names)

    id_type = pa.int64()
    both = written(docs.mapInArrow(run, "id bigint, n bigint, fp binary, chunk int, counts binary"), "profiles")
    return both.filter("chunk is null").select("id", "n", "fp"), both.filter("chunk is not null").select("chunk", "counts")


def frequency(counts: DataFrame) -> np.ndarray:
    """The summed counters: COUNTERS numbers, whatever the corpus."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for c in t.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), "<i4")
        total = np.minimum(total, 2**31 - 1).astype("<i4")
        return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, counts binary"
    salted = counts.withColumn("salt", F.spark_partition_id() % 64).groupBy("chunk", "salt").applyInArrow(add, schema)
    got = salted.groupBy("chunk").applyInArrow(add, schema).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    for chunk, raw in zip(got.column("chunk").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(raw), "<i4")
    return out


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links to: J >= p means overlap >= p * max(size)."""
    return -(-percent * n // 100)


def prefix(own: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The longest prefix that may be read, in the global order (level, hash), and how much of it comes before any match is asked for."""
    lv = level[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.lexsort((own, lv)) if lv.any() else np.arange(len(own))
    must = least_overlap(len(own), percent)
    base = len(own) - must
    return own[order[: base + min(must, base // 3 + 2)]], base


def postings(docs: DataFrame, k: int, percent: int, seen: np.ndarray) -> DataFrame:
    """(id, n, base, tokens) of each (id, text) with words: the prefix may hold up to len(tokens) - base matches."""
    mean = seen.sum() / COUNTERS
    level = np.maximum(0, np.floor(np.log2(np.maximum(seen, 1) / (2 * mean + 8)))).astype(np.int8)
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = shared.value
        for b in batches:
            ids, kept, n, bases, tokens = b.column("id").to_pylist(), [], [], [], []
            for i, own in zip(ids, sets(b.column("text"), k), strict=True):
                if len(own):
                    first, base = prefix(own, lv, percent)
                    kept.append(i)
                    n.append(len(own))
                    bases.append(base)
                    tokens.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(n, pa.int64()), pa.array(bases, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["id", "n", "base", "tokens"])

    return docs.mapInArrow(run, "id bigint, n bigint, base int, tokens array<bigint>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between the sets of a and those of b."""
    if len(a) == len(b) == 1:
        return np.array([[len(np.intersect1d(a[0], b[0], assume_unique=True))]])
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.int64)

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    if not len(both):
        return out
    (ca, ra), (cb, rb) = cells(a), cells(b)
    for s in range(0, len(both), 4096):
        width = min(4096, len(both) - s)
        parts = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            lo, hi = np.searchsorted(c, (s, s + width))
            m = np.zeros((n, width), np.float32)
            m[r[lo:hi], c[lo:hi] - s] = 1
            parts.append(m)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def block_links(a_ids: np.ndarray, a: list[np.ndarray], b_ids: np.ndarray, b: list[np.ndarray], same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents of two blocks, each with the least id it reaches inside them."""
    inter = overlaps(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - inter
    near = 100 * inter >= percent * union
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right, top = a_ids.copy(), b_ids.copy(), np.iinfo(np.int64).max
    while True:
        x = np.minimum(left, np.where(near, right[None, :], top).min(axis=1))
        y = np.minimum(right, np.where(near, x[:, None], top).min(axis=0))
        if same:
            x = y = np.minimum(x, y)
        if (x == left).all() and (y == right).all():
            break
        left, right = x, y
    keep = near.any(axis=1)
    if same:
        return a_ids[keep], left[keep]
    other = near.any(axis=0)
    return np.r_[a_ids[keep], b_ids[other]], np.r_[left[keep], right[other]]


def adapted(flat: DataFrame) -> DataFrame:
    """Postings (id, n, m, token, docs) of the prefixes that the documents choose.

    flat: (id, n, base, most, pos, token). With m matches a document reads the
    lists of its first base + m shingles; at most that many postings over m are
    candidates, each verified at the cost of its set. The m of least cost wins,
    the smaller on ties. Shingles in one prefix only find nobody and are dropped.
    """
    popular = flat.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1")
    shared = written(flat.join(popular, "token"), "postings")
    cost = """array_min(transform(sequence(1, most), m -> struct(
        aggregate(filter(reads, x -> x.pos < base + m), 0D, (s, x) -> s + x.docs - 1) * (1 + n / m) as cost, m as m))).m"""
    own = shared.groupBy("id", "n", "base", "most").agg(F.collect_list(F.struct("pos", "docs")).alias("reads"))
    own = own.select("id", F.expr(cost).alias("m"))
    return shared.join(own, "id").filter("pos < base + m").select("id", "n", "m", "token", "docs")


def candidate_groups(chosen: DataFrame, percent: int) -> DataFrame:
    """(id, home, target): documents to verify together, from adapted postings.

    A document's home is a bounded block of those of about its size whose
    prefixes share its most popular shingle. It goes to every block, its own
    included, with which it shares as many prefix shingles as it or a member of
    the block asks for and whose sizes allow a link, if some member of that block
    also goes to its home.
    """
    band = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    home = written(chosen.groupBy("id", "n", "m").agg(F.max(F.struct("docs", "token"))["token"].alias("key")).withColumn("band", band), "home-keys")
    sizes = written(home.groupBy("key", "band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("subs"), F.count("*").alias("members")), "home-sizes")
    home = attach(home, sizes, ["key", "band"], "members", home.count()).withColumn("block", F.xxhash64("key", "band", F.pmod(F.xxhash64("id"), F.col("subs"))))
    home = written(home.select("id", "n", "m", "block"), "homes")
    placed = written(chosen.join(home.select("id", F.col("block").alias("home")), "id").select("id", "n", "m", "token", "home"), "placed")
    blocks = home.groupBy(F.col("block").alias("target")).agg(F.min("m").alias("least"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    fits = (100 * F.col("hi") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("lo"))
    listed = placed.groupBy("token", F.col("home").alias("target")).agg(F.count("*").alias("members")).join(blocks, "target")
    met = placed.join(listed, "token").filter(fits & ((F.col("home") != F.col("target")) | (F.col("members") > 1)))
    goes = met.groupBy("id", "home", "target").agg(F.count("*").alias("common"), F.first(F.least("m", "least")).alias("need"))
    goes = written(goes.filter("common >= need").select("id", "home", "target"), "goes")
    back = goes.select(F.col("target").alias("home"), F.col("home").alias("target")).distinct()
    return goes.join(back, ["home", "target"], "left_semi")


def class_edges(docs: DataFrame, classes: DataFrame, k: int, percent: int, seen: np.ndarray) -> DataFrame:
    """Edges (a, b) that connect the representatives of linked classes."""
    reps = classes.filter("n > 0").select(F.col("rep").alias("id"))
    own = written(postings(docs, k, percent, seen).join(reps, "id", "left_semi").dropDuplicates(["id"]), "prefixes")
    flat = own.select("id", "n", "base", (F.size("tokens") - F.col("base")).alias("most"), F.posexplode("tokens").alias("pos", "token"))
    groups = written(candidate_groups(written(adapted(flat), "adapted"), percent), "groups")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [own.tobytes() for own in sets(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, pa.binary())], ["id", "own"])

    # always dealt by id: a broadcast below some size would make the cost jump there
    texts = docs.hint("merge").join(groups.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    work = groups.join(texts.mapInArrow(filled, "id bigint, own binary"), "id").groupBy(F.least("home", "target").alias("lo"), F.greatest("home", "target").alias("hi"))
    work = work.agg(F.collect_list(F.struct("home", "id", "own")).alias("rows"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.empty(0, np.int64),) * 2]
            for lo, hi, rows in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), batch.column("rows"), strict=True):
                rows, sides = rows.as_py(), []
                for block in (lo, hi):
                    own = [r for r in rows if r["home"] == block]
                    sides += [np.array([r["id"] for r in own], np.int64), [np.frombuffer(r["own"], np.uint64) for r in own]]
                found.append(block_links(*sides, same=lo == hi, percent=percent))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b"])

    return work.mapInArrow(verify, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row per input row.

    Documents link when the Jaccard similarity of their sets of k-word shingles
    is at least percent / 100; component_id is the smallest id reachable. Texts
    without words (null, empty, white space) have an empty set and link with
    nothing, as do rows with a null id, whose component is null. Rows that repeat
    an id must repeat its text; of differing ones any is taken. Shingles
    are compared as 64-bit hashes. An empty table gives no rows. Other columns
    are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    facts, counts = profiles(own, k)
    classes = facts.filter("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("size"))
    classes = written(classes, "classes")
    edges = class_edges(own.filter("id is not null"), classes, k, percent, frequency(counts))
    reach = components(edges)
    classes = classes.join(reach, F.col("rep") == F.col("node"), "left").select("fp", "size", F.coalesce("component", "rep").alias("component_id"))
    out = attach(facts, written(classes, "class-components"), "fp", "size", facts.count())
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def near_dedup_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, all columns as they were; of rows that repeat an id, one.

    Documents with a null id link with nothing and all stay.
    """
    kept = jaccard_components(docs, k, percent).filter(F.col("id") == F.col("component_id")).select("id")
    return kept_once(docs, [docs["doc_id"].cast("long")], kept).unionByName(docs.filter("doc_id is null"))
