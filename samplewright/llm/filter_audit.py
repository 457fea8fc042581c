"""Interaction of document filters, from sorted posting lists.

Rows are dealt into ranges of (part, id). A range keeps, for every filter, the
sorted list of the rows that fail it, and those of the labelled sets. Galloping
k-way merges of a range's lists give the sizes of the union of every set of
filters, alone and within the labelled sets; what a filter removes after others
is the difference of two unions. Sizes are summed over the ranges of a part, so
every order of the filters is answered from them, and no list leaves its range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, attach, unused, written

#: Rows of a range at most, and those that a merge brings together in a step.
RANGE_ROWS, STEP = 1 << 17, 4096


def gallop(a: np.ndarray, start: int, end: int) -> int:
    """The first place from start on whose value is end or more: steps that double, then halving."""
    step, hi = 1, start
    while hi < len(a) and a[hi] < end:
        start, hi, step = hi + 1, hi + step, 2 * step
    return start + int(np.searchsorted(a[start : min(hi, len(a))], end))


def merged(lists: Sequence[np.ndarray], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Galloping k-way merge of sorted lists without repeats: (values, which lists hold them as a matrix), window by window.

    A window ends where the first list has run `step` further, or, while only one
    list has values there, at the head of the next list: that run is taken whole.
    """
    at = [0] * len(lists)
    while heads := sorted((int(a[i]), k) for k, (a, i) in enumerate(zip(lists, at, strict=True)) if i < len(a)):
        first = heads[0][1]
        alone = heads[1][0] if len(heads) > 1 else int(lists[first][-1]) + 1
        if alone - heads[0][0] > step:
            ends = {first: gallop(lists[first], at[first], alone)}
        else:
            end = min(int(lists[k][min(at[k] + step, len(lists[k])) - 1]) for _, k in heads) + 1
            ends = {k: gallop(lists[k], at[k], end) for _, k in heads}
        runs = {k: lists[k][at[k] : e] for k, e in ends.items()}
        values = runs[first] if len(runs) == 1 else np.unique(np.concatenate(list(runs.values())))
        held = np.zeros((len(lists), len(values)), bool)
        for k, run in runs.items():
            held[k, np.searchsorted(values, run)] = True
            at[k] = ends[k]
        yield values, held


def union_sizes(fails: Sequence[np.ndarray], marks: Sequence[np.ndarray]) -> np.ndarray:
    """Of every set of fail lists (a bit each): size of the union, and of its meet with every mark list."""
    n = len(fails)
    sizes = np.zeros((1 << n, 1 + len(marks)), np.int64)
    for _, held in merged([*fails, *marks]):
        unions = [np.zeros(held.shape[1], bool)]
        for s in range(1, 1 << n):
            low = (s & -s).bit_length() - 1
            unions.append(unions[s & (s - 1)] | held[low])
            sizes[s] += [np.count_nonzero(unions[s]), *(np.count_nonzero(unions[s] & m) for m in held[n:])]
    return sizes


def posting_lists(rows: DataFrame, filters: str, marks: str) -> DataFrame:
    """(part, first_id, last_id, lists), written: the sorted lists of ranges of (part, id), from (part, id, h, bits).

    bits: of each row, a bit for every letter of filters and then of marks. A list
    holds the row's place in its range and its id; the place tells rows with one id apart.
    """
    letters = filters + marks
    entry = pa.struct([("letter", pa.string()), ("place", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    names = ["part", "first_id", "last_id", "lists"]

    def listed(part: str, ids: np.ndarray, known: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        lists = []
        for k, letter in enumerate(letters):
            place = np.flatnonzero(bits >> k & 1).astype(np.int32)
            lists.append({"letter": letter, "place": place, "ids": [int(i) if ok else None for i, ok in zip(ids[place], known[place], strict=True)]})
        ends = [int(ids[k]) if known[k] else None for k in (0, -1)]
        return pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([e], pa.int64()) for e in ends), pa.array([lists], pa.list_(entry))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            parts = b.column("part").to_pylist()
            cuts = [0, *(i for i in range(1, len(parts)) if parts[i] != parts[i - 1]), len(parts)] if parts else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and (parts[lo] != part or sum(len(x[0]) for x in held) + hi - lo > RANGE_ROWS):
                    yield listed(part, *(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                ids = b.column("id").slice(lo, hi - lo)
                part = parts[lo]
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), b.column("bits").slice(lo, hi - lo).to_numpy(zero_copy_only=False)))
        if held:
            yield listed(part, *(np.concatenate(c) for c in zip(*held, strict=True)))

    ranges = rows.repartitionByRange("part", "id", "h").sortWithinPartitions("part", "id", "h").select("part", "id", "bits")
    schema = "part string, first_id bigint, last_id bigint, lists array<struct<letter string, place array<int>, ids array<bigint>>>"
    return written(ranges.mapInArrow(run, schema), "posting-lists")


def removals(lists: DataFrame, filters: str, marks: str) -> DataFrame:
    """(part, before, filter, removed, <mark>_lost...): rows that a filter removes after the set `before` (a bit a filter) of others, of every part."""
    n, names = len(filters), ["removed", *(f"{m}_lost" for m in marks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own = b.column("lists")[r].values
                place = dict(zip(own.field("letter").to_pylist(), own.field("place"), strict=True))
                fails, held = ([place[x].values.to_numpy() for x in letters] for letters in (filters, marks))
                sizes = union_sizes(fails, held)
                steps = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
                lost = np.array([sizes[s | 1 << f] - sizes[s] for s, f in steps])
                cols = [pa.array([b.column("part")[r].as_py()] * len(steps)), pa.array([s for s, _ in steps], pa.int32()), pa.array([filters[f] for _, f in steps])]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c) for c in lost.T)], ["part", "before", "filter", *names])

    schema = "part string, before int, filter string, " + ", ".join(f"{c} bigint" for c in names)
    return lists.mapInArrow(run, schema).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in names])


def orders(spark, filters: str) -> DataFrame:
    """(filter_order, step, filter, before): every order of the filters, step by step; a table of fixed size."""
    bit = {x: 1 << k for k, x in enumerate(filters)}
    out = [("".join(p), k + 1, p[k], sum(bit[x] for x in p[:k])) for p in permutations(filters) for k in range(len(p))]
    return spark.createDataFrame(out, "filter_order string, step int, filter string, before int")


def audit(rows: DataFrame, filters: str, marks: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost..., shapley), for every part, order and step.

    rows: (part, id, h, bits) as in posting_lists. Rows with one id are counted on
    their own; a null id is an id like others. An empty table gives no rows.
    """
    spark, own = rows.sparkSession, written(rows, "audited")
    lost = written(removals(posting_lists(own, filters, marks), filters, marks), "removals")
    sizes = own.groupBy("part").agg(F.count("*").alias("rows"))
    every = (1 << len(filters)) - 1
    bit = F.element_at(F.create_map(*[F.lit(v) for k, x in enumerate(filters) for v in (x, 1 << k)]), F.col("filter"))
    alone = F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails")
    unique = F.max(F.when(F.col("before") == F.lit(every) - bit, F.col("removed"))).alias("unique_fails")
    steps = F.broadcast(orders(spark, filters))  # factorial of the number of filters, times their number
    placed = lost.join(steps, ["before", "filter"])
    shapley = placed.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    of_filter = lost.groupBy("part", "filter").agg(alone, unique).join(shapley, ["part", "filter"])
    # rows left after a step: those that no filter up to it removed, by the chain of steps of the order
    gone = lost.select("part", F.col("before").alias("_b"), F.col("filter").alias("_f"), F.col("removed").alias("_r"))
    first = gone.join(F.broadcast(_chains(spark, filters)), ["_b", "_f"]).groupBy("part", "upto").agg(F.sum("_r").alias("gone"))
    out = placed.withColumn("upto", F.col("before") + bit).join(first, ["part", "upto"]).join(of_filter, ["part", "filter"]).join(sizes, "part")
    losses = [f"{m}_lost" for m in marks]
    return out.select("part", "filter_order", "step", (F.col("rows") - F.col("gone")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *losses, "shapley")


def _chains(spark, filters: str) -> DataFrame:
    """(upto, _b, _f): of every set of filters, the steps that add them in alphabetical place; a table of fixed size."""
    out = []
    for s in range(1, 1 << len(filters)):
        for k, x in enumerate(filters):
            if s >> k & 1:
                out.append((s, s & ((1 << k) - 1), x))
    return spark.createDataFrame(out, "upto int, _b int, _f string")


def document_filters(text: Column, copy: Column) -> dict[str, Column]:
    """The conditions under which a document fails: A short, B repetitive, C upper-case, D symbols, E a copy."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"))
    n = F.size(words)
    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * upper.cast("long") > 5 * F.length(t).cast("long"),
        "D": F.length(F.translate(t, "#$%&*|", "")) < F.length(t),
        "E": copy,
    }


def audit_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good: Column | None = None, toxic: Column | None = None
) -> DataFrame:
    """audit of the document filters: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A null text is empty, a null part the empty string. A document is a copy if a
    smaller id has its text, anywhere in the table; texts are compared by SHA-256
    and length. A null id is no smaller than any and never makes a copy. A document
    is good or toxic if any of the rows of labels (doc_id, quality, toxic) with its
    id says so; labels without a document count nowhere. Other columns are not read.
    """
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    text = F.coalesce(F.col(text_col), F.lit(""))
    conditions = document_filters(F.col(text_col), F.lit(False))
    letters = list(conditions)
    bits = reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(conditions.values())])
    own = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("bits"), F.concat(F.sha2(text, 256), F.lit("-"), F.length(text).cast("string")).alias("same")
    )
    own = written(own, "filtered")
    copies = written(own.groupBy("same").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1"), "equal-texts")
    met = attach(own, copies, "same", "n", own.count())
    said = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.coalesce(good, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(toxic, F.lit(False)).cast("int")).alias("toxic"))
    n = len(letters)
    copy = F.when(F.col("id") > F.col("least"), F.lit(1 << letters.index("E"))).otherwise(F.lit(0))
    marks = F.coalesce("good", F.lit(0)) * F.lit(1 << n) + F.coalesce("toxic", F.lit(0)) * F.lit(2 << n)
    rows = met.join(said, "id", "left").select("part", "id", F.xxhash64("same").alias("h"), F.col("bits").bitwiseOR(copy).bitwiseOR(marks).alias("bits"))
    got = audit(rows, "".join(letters), "GT")
    return got.withColumnsRenamed({"G_lost": "good_lost", "T_lost": "toxic_lost"})


def audit_sql() -> str:
    """The audit of documents in DuckDB's SQL: flags of every document, then counts along every order."""
    return r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END)::INTEGER AS bits
  FROM d LEFT JOIN m ON d.doc_id = m.doc_id
), c AS (
  SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), o(filter_order, before, bit, step) AS (
  SELECT x, 0, 1 << (ascii(x) - 65), 1 FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
  UNION ALL
  SELECT filter_order || x, before | bit, 1 << (ascii(x) - 65), step + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), p AS (
  SELECT w.filter_order, s.step, s.bit, s.before FROM o w JOIN o s ON starts_with(w.filter_order, s.filter_order) WHERE w.step = 5
), r AS (
  SELECT part, filter_order, step, bit, before,
    coalesce(sum(n) FILTER (bits & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bits & bit <> 0 AND bits & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (bits & bit <> 0 AND bits & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, p GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
