"""Exact dedup, Jaccard join, embeddings and passages against brute force, with edge cases."""

import hashlib
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.llm import embedding_dedup, exact_dedup, jaccard_join, substring_dedup
from samplewright.llm.common import components
from samplewright.llm.queries import OP7_SQL, QUERIES

ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, digest int, component int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 997}x{i // 7}" for i in range(20_000))
    texts = [None, "", " \t\n", "a b c", "abc", "A b c", long, long + " tail", "one", "one", None, "é b c"]
    rows = [(i, t, None, None, None, "x", 1, 2) for i, t in enumerate(texts)] + [(8, "one", "en", "s", 3, "y", 0, 0), (None, "nobody", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, percent):
    sets, parent = {i: shingles(t, k) for i, t in texts}, {}
    for i in sorted(sets):
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            inter = len(sets[i] & sets[j])
            if inter and 100 * inter >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_fuse_filter_has_its_keys_and_few_others():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 100, 30_000):
        keys = rng.integers(0, 2**63, n, dtype=np.uint64)
        own = exact_dedup.FuseFilter.build(keys)
        assert own.has(keys).all()
        assert own.has(rng.integers(0, 2**63, 100_000, dtype=np.uint64)).mean() < 1e-3
        assert len(own.cells) < 1.6 * n + 64


def test_exact_dedup_matches_sql(same_rows):
    same_rows(QUERIES["op7_exact_dedup"], OP7_SQL)


def test_exact_dedup_of_odd_rows(spark, odd):
    got = exact_dedup.exact_dedup(odd, exact_dedup.arrival(), exact_dedup.N_BATCHES).collect()
    assert len(got) == odd.count()
    by = {r["id"]: r for r in got}
    assert {by[i]["keep_id"] for i in (0, 1, 2, 10)} == {2} and by[0]["group_size"] == 4  # white space has most code points
    assert by[3]["keep_id"] == by[4]["keep_id"] == 3 and by[5]["keep_id"] == 5  # case counts
    assert by[8]["group_size"] == 3 and by[9]["keep_id"] == 8 and by[None]["kept"]
    assert bytes(by[11]["digest"]).hex() == hashlib.sha256("ébc".encode()).hexdigest()
    kept = exact_dedup.dedup_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 5, 6, 7, 8, 11, None}
    assert exact_dedup.exact_dedup(odd.limit(0), exact_dedup.arrival(), 3).count() == 0


def test_a_lost_positive_splits_its_class(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"t {i % 3}") for i in range(9)] + [(None, "t  0")], "doc_id long, text string")
    batch = F.coalesce(F.col("doc_id"), F.lit(8)).cast("int") / 3

    def run():
        return {r["id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs, F.floor(batch).cast("int"), 3).collect()}

    whole, screen, lost = run(), exact_dedup.screen, hashlib.sha256(b"t1").digest()
    assert whole == {**{i: (i % 3 or None, 3) for i in range(9)}, **{i: (None, 4) for i in (None, 0, 3, 6)}}
    monkeypatch.setattr(exact_dedup, "screen", lambda own, *a: screen(own, *a).filter(F.col("digest") != F.lit(lost)))
    assert run() == whole | {i: (i, 1) for i in (1, 4, 7)}


def test_screen_passes_every_stored_digest(spark):
    own = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    filters = exact_dedup.build_filters(own.limit(3000), 4)
    assert exact_dedup.screen(own, filters, 4).count() < 3010
    assert exact_dedup.screen(own, filters, 4).join(own.limit(3000), "digest").count() == 3000


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50), (3, 100)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    rng, base = np.random.default_rng(k), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(160):
        w = list(base) if i % 3 else [f"v{rng.integers(60)}" for _ in range(int(rng.integers(0, 80)))]
        for _ in range(int(rng.integers(0, 7))):
            if w:
                w[int(rng.integers(len(w)))] = f"e{rng.integers(9)}"
        texts.append((i, " ".join(w[: int(rng.integers(100, 130))])))
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), k, percent).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, k, percent)


def test_jaccard_of_odd_rows(spark, odd):
    got = jaccard_join.jaccard_components(odd, 3, 90).collect()
    assert len(got) == odd.count()
    by = {r["id"]: r for r in got}
    assert by[0]["n_shingles"] == 0 and by[0]["component_id"] == 0 and by[2]["component_id"] == 2
    assert by[5]["component_id"] == 3 and by[4]["component_id"] == 4 and by[7]["component_id"] == 6
    assert by[9]["component_id"] == 8 and by[None]["component_id"] is None
    kept = jaccard_join.near_dedup_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 6, 8, 10, 11, None}
    assert jaccard_join.jaccard_components(odd.limit(0)).count() == 0


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 9000, int(n)).astype(np.uint64)) for n in rng.integers(1, 6000, 7)] for _ in range(2))
    assert (jaccard_join.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, 64)) * s for s in (0.05, 0.2, 0.34)] + [rng.normal(size=(200, 64))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r["id"]: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_embedding_edge_cases(spark):
    v = [1.0] + [0.5] * 7
    rows = [(0, v), (1, v), (2, [2 * a for a in v]), (3, None), (4, [0.0] * 8), (5, [None] + v[1:]), (6, [float("nan")] + v[1:]), (7, [float("inf")] + v[1:]), (8, v[:3]), (None, v), (1, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "code": F.lit(1)})
    got = embedding_dedup.link(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[0] == (3, 0, True) and by[2] == (3, 0, False) and by[1] == (4, 0, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8)) and by[None] == (0, None, True)
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_embedding_links_off_a_common_mean(spark):
    rng = np.random.default_rng(8)
    mean = np.eye(64)[0]
    own = rng.normal(size=(300, 64)) / 8
    own[150:] = own[:150] * 0.54 + rng.normal(size=(150, 64)) / 8 * np.sqrt(1 - 0.54**2)
    x = np.sqrt(0.8) * mean + np.sqrt(0.2) * own
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [1.0, 2.0, 3.0]) for i in range(2)]
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9).sum() - len(x)
    got = {r["id"]: r for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert near > 100 and 0.9 * near <= sum(r["n_links"] for i, r in got.items() if i < 1000) <= near
    assert got[1001]["component_id"] == 1000 and got[1000]["n_links"] == 1  # of another length than most


@pytest.mark.parametrize(("d", "mean"), [(8, 0.0), (64, 0.0), (64, 0.8), (384, 0.0)])
def test_embedding_recall_just_above_the_threshold(spark, d, mean):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(200, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    of, t = rng.integers(0, 200, 400), rng.uniform(0.88, 0.97, 400)
    cos = np.clip((t - mean) / (1 - mean), -1, 1)[:, None]
    off = rng.normal(size=(400, d))
    off -= (off * base[of]).sum(axis=1, keepdims=True) * base[of]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.sqrt(mean) * np.eye(d)[0] + np.sqrt(1 - mean) * np.vstack([base, cos * base[of] + np.sqrt(1 - cos**2) * off])
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r["id"]: r["n_links"] for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()


@pytest.mark.parametrize(("mean", "warned"), [(0.8, True), (0.0, False)])
def test_no_link_is_lost_where_tables_do_not_pay(spark, mean, warned):
    """Vectors close together by their mean: all are compared, whatever the tables could find; else the tables serve."""
    rng = np.random.default_rng(4)
    own = rng.normal(size=(6000, 64))
    own[5700:] = own[:300] * 0.8 + rng.normal(size=(300, 64)) * 0.6
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    x = (np.sqrt(mean) * np.eye(64)[0] + np.sqrt(1 - mean) * own).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        got = {r["id"]: r["n_links"] for r in embedding_dedup.link(rows).collect()}
    assert any("compared in blocks" in str(w.message) for w in said) == warned
    found = np.array([got[i] for i in range(len(x))])
    if warned:
        assert near.sum() > 500 and (found == near).all()
    else:
        assert (found <= near).all() and found.sum() >= 0.95 * near.sum()


def test_embedding_query_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in QUERIES["op3_embedding_near_dedup"](spark, data).collect()}
    found = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert len(got) == len(rows) and (found <= near.sum(axis=1)).all() and found.sum() >= 0.9 * near.sum()
    reach = np.array([r["vec_id"] for r in rows])
    for _ in range(len(rows)):
        reach = np.minimum(reach, np.where(near, reach[None, :], reach.max()).min(axis=1))
    if found.sum() == near.sum():
        assert [got[r["vec_id"]]["component_id"] for r in rows] == reach.tolist()


def test_unrelated_codes_meet_seldom(spark):
    counts = []
    for n in (3000, 12_000):
        x = np.random.default_rng(n).normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = embedding_dedup.learn(x[:10_000], n, 0.9)
        half = n / 2 ** np.bitwise_count(index.masks).sum(axis=1).max() / 2  # partners of a code in one table
        counts.append(n * half * len(index.masks))
        codes = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(index.codes(x))], "code long, c0 long, c1 long")
        assert embedding_dedup.near_codes(codes, index.masks, index.most).count() < n / 20
    assert counts[1] < 8 * counts[0]


def test_near_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CODES", 5)  # buckets are cut into parts
    rng = np.random.default_rng(3)
    c = np.unique(rng.integers(0, 2**62, (6, 2))[rng.integers(0, 6, 150)] ^ (1 << rng.integers(0, 62, (150, 2))), axis=0)
    masks, most = np.array([[0xFF, 0xF0], [0xFF00, 0xF], [0xF000F, 0xF000]], np.uint64), 4
    got = [tuple(sorted(r)) for r in embedding_dedup.near_codes(spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(c)], "code long, c0 long, c1 long"), masks, most).collect()]
    x = (c[:, None] ^ c[None]).view(np.uint64)
    near = (np.bitwise_count(x).sum(axis=2) <= most) & ((x[:, :, None] & masks[None, None] == 0).all(axis=3)).any(axis=2)
    assert sorted(got) == [(i, j) for i in range(len(c)) for j in range(i + 1, len(c)) if near[i, j]]


def test_many_equal_vectors_are_one_class(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(3000)] + [(5000, [2.0, 4.0, 6.0]), (5001, [-1.0, 0.0, 0.0]), (5001, [1.0, 2.0, 3.0])]
    got = {(r["id"], r["n_links"], r["component_id"]) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(i, 3001, 0) for i in [*range(3000), 5000]} | {(5001, 3001, 0)}


def test_compact_windows_group_subsequences_by_their_least_hash():
    rng, least = np.random.default_rng(2), 8
    sequences = [rng.integers(0, 2**63, 90, dtype=np.uint64), rng.integers(0, 5, 40).astype(np.uint64) << np.uint64(40), np.zeros(30, np.uint64), np.arange(8, dtype=np.uint64) << np.uint64(40), rng.integers(0, 2**63, 7, dtype=np.uint64)]
    owner = np.repeat(np.arange(len(sequences)), [len(h) for h in sequences])
    h, got = np.concatenate(sequences), {}
    for l, c, r in zip(*substring_dedup.compact_windows(h, owner, least), strict=True):  # noqa: E741
        for i in range(l, r - least + 2):
            assert got.setdefault(i, c) == c and len(set(owner[i : i + least])) == 1
            assert i not in got or got[i] == c
    want = {i: i + int(h[i : i + least].argmin()) for i in range(len(h) - least + 1) if owner[i] == owner[i + least - 1]}
    assert got == want  # each in one window, that of its first least hash
    # a window is a node of the Cartesian tree as far as it reaches: one wider has a lesser hash or is out of reach
    for l, c, r in zip(*substring_dedup.compact_windows(h, owner, least), strict=True):  # noqa: E741
        assert (h[l : r + 1] >= h[c]).all() and c - l < least and r - c < least
        assert c - l == least - 1 or l == 0 or owner[l - 1] != owner[l] or h[l - 1] <= h[c]
        assert r - c == least - 1 or r + 1 == len(h) or owner[r + 1] != owner[r] or h[r + 1] < h[c]


def test_repeated_passages_are_found(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"t{rng.integers(10**9)}" for _ in range(n)]
    shared, texts = fresh(80), []
    for i in range(12):
        own = list(shared)
        if i % 4 == 3:
            own[40] = f"edit{i}"
        texts.append((i, " ".join(fresh(70) + own + fresh(30))) if i % 2 else (i, " ".join(fresh(200))))
    inner = fresh(60)
    texts += [(20, " ".join(inner + fresh(50) + inner)), (21, " ".join(fresh(20) + shared[:40] + fresh(50))), (22, None), (23, ""), (24, "a b"), (None, " ".join(shared))]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit("x"))
    got = substring_dedup.repeated_passages(df, within=True).collect()
    assert {r["id"] for r in got} == {3, 5, 7, 9, 11, 20}
    assert {r["id"] for r in substring_dedup.repeated_passages(df).collect()} == {3, 5, 7, 9, 11}  # across texts alone
    for r in got:
        if r["id"] != 20:
            assert r["other_id"] < r["id"] and r["start"] <= 74 and r["end"] >= 146 and r["similarity"] >= 0.8
        else:
            assert (r["start"], r["end"], r["other_start"], r["other_end"]) == (110, 170, 0, 60)
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(df, substring_dedup.repeated_passages(df, within=True)).collect()}
    assert len(words(cut[20])) == 110 and cut[0] == texts[0][1] and cut[22] is None
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_holders_of_fragments_hide_no_passage(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"t{rng.integers(10**9)}" for _ in range(n)]
    texts, want = [], set()
    for g in range(12):  # the least ids hold 45 words of a passage of 60, two or more later texts hold all of it
        shared, at, late = fresh(60), 10 * g, range(6, 8 + g % 3)
        texts += [(at + k, fresh(30) + shared[s : s + 45] + fresh(30)) for k, s in enumerate([0, 15, 7, 0, 11, 4][: 1 + g % 6])]
        texts += [(at + k, fresh(40) + shared + fresh(20)) for k in late]
        want |= {(at + k, at + 6) for k in late[1:]}
    # text 201 repeats one passage of 200 in full, of the other only text 202 does
    one, two = fresh(70), fresh(70)
    texts += [(200, one + fresh(30) + two[:45]), (201, fresh(9) + one + fresh(9) + two), (202, two + fresh(50) + one)]
    want |= {(201, 200), (202, 200), (202, 201)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    by = {i: w for i, w in texts}
    assert want <= {(r["id"], r["other_id"]) for r in got} and {r["id"] for r in got} == {i for i, _ in want}
    assert all(by[r["id"]][r["start"] : r["end"]] == by[r["other_id"]][r["other_start"] : r["other_end"]] and r["end"] - r["start"] >= 60 for r in got)


@pytest.mark.parametrize(("heads", "part", "size"), [(2, 40, 60), (3, 45, 60), (2, 40, 50), (6, 45, 100)])
def test_no_verbatim_passage_is_lost_to_decoys(spark, heads, part, size):
    rng = np.random.default_rng(part + size)
    fresh = lambda n: [f"t{rng.integers(10**9)}" for _ in range(n)]
    texts, want = {}, {}
    for g in range(0, 3000, 100):  # texts before the two that share a passage hold a part of it
        shared = fresh(size)
        for k in range(heads):
            s = int(rng.integers(0, size - part + 1))
            texts[g + k] = fresh(30) + shared[s : s + part] + fresh(30)
        texts[g + 50], texts[g + 60] = fresh(40) + shared + fresh(20), fresh(25) + shared + fresh(35)
        want[g + 60] = (25, 25 + size, g + 50, 40, 40 + size, 1.0)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r["id"], r["other_id"]): tuple(r)[1:] for r in substring_dedup.repeated_passages(df).collect()}
    assert all(got[i, w[2]] == w for i, w in want.items())


@pytest.mark.parametrize(("heads", "part"), [(2, 40), (3, 45)])
def test_few_similar_passages_are_lost_to_decoys(spark, heads, part):
    rng = np.random.default_rng(part)
    fresh = lambda n: [f"t{rng.integers(10**9)}" for _ in range(n)]
    texts, want = {}, set()
    for g in range(0, 6000, 100):  # no 50 words in a row are equal: only the min-hashes lead to the pair
        shared = fresh(60)
        other = [*shared[:30], "edit", *shared[31:]]
        for k in range(heads):
            s = int(rng.integers(0, 60 - part + 1))
            texts[g + k] = fresh(30) + shared[s : s + part] + fresh(30)
        texts[g + 50], texts[g + 60] = fresh(40) + shared + fresh(20), fresh(25) + other + fresh(35)
        want.add((g + 60, g + 50))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r["id"], r["other_id"]) for r in substring_dedup.repeated_passages(df).collect() if r["similarity"] >= 0.8}
    assert len(want & got) >= 0.95 * len(want)  # as without decoys: two of four functions must agree


def test_similar_passages_in_context_are_found(spark):
    rng = np.random.default_rng(9)
    fresh = lambda n: [f"t{rng.integers(10**9)}" for _ in range(n)]
    texts, want = [], 0
    for g in range(150):
        shared = fresh(int(rng.integers(60, 160)))
        other = list(shared)
        for at in rng.choice(len(other) - 10, max(1, len(other) // 50), replace=False) + 5:
            other[at] = f"e{g}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (shared, other))
        assert len(a & b) >= 0.8 * len(a | b)
        texts += [(2 * g, " ".join(fresh(40) + shared + fresh(60))), (2 * g + 1, " ".join(fresh(70) + other + fresh(30)))]
        want += 1
    rows = substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r["other_id"] == r["id"] - 1 and r["similarity"] >= 0.8 for r in rows)
    assert len({r["id"] for r in rows}) >= 0.95 * want


def test_every_verbatim_passage_of_the_table_is_covered(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    rows, cover, first = QUERIES["op6_substring_dedup"](spark, data).collect(), {}, {}
    for r in rows:
        cover.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        a, b = (shingles(" ".join(w.decode("utf-8", "surrogatepass") for w in texts[i][s:e]), 5) for i, s, e in ((r["doc_id"], r["start"], r["end"]), (r["other_doc_id"], r["other_start"], r["other_end"])))
        assert r["other_doc_id"] < r["doc_id"] and r["end"] - r["start"] >= 50
        assert len(a & b) / len(a | b) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8
    for i, w in sorted(texts.items()):
        own = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, gram in enumerate(own):
            assert gram not in first or any(s <= j and j + 50 <= e for s, e in cover.get(i, []))
        first.update((gram, i) for gram in own if gram not in first)


def test_passages_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    long, shared = [f"w{x}" for x in rng.integers(0, 10**6, 300_000)], [f"s{k}" for k in range(55)]
    rows = [(1, long + shared), (2, shared + ["a"] * 200), (3, ["a"] * 120), (4, None), (5, []), (5, shared), (5, shared), (None, shared), (None, None), (6, ["x" * 300_000, *shared])]
    df = spark.createDataFrame([(i, None if w is None else " ".join(w), "y", 1) for i, w in rows], "doc_id long, text string, key string, spot int")
    got = {(r["id"], r["other_id"]): (r["start"], r["end"], r["other_start"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert got.keys() == {(2, 1), (3, 2), (5, 1), (6, 1)}  # of the rows with id 5 the empty text does not count
    assert got[2, 1] == (0, 55, 300_000) and got[6, 1] == (1, 56, 300_000) and got[3, 2][:2] == (0, 120)


def test_repeated_ids_count_with_their_greatest_text(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, "zz nothing here"), (2, f"a {passage}"), (3, f"b {passage}"), (3, "a"), (4, None), (4, passage)]
    for own in (rows, rows[::-1]):
        got = substring_dedup.repeated_passages(spark.createDataFrame(own, "doc_id long, text string").repartition(3)).collect()
        assert {(r["id"], r["start"], r["end"], r["other_id"]) for r in got} == {(3, 1, 61, 1), (4, 0, 60, 1)}


def test_pairs_of_a_head_that_many_repeat_are_dealt(spark):
    pairs = spark.range(1, 20_001).select("id", F.when(F.col("id") <= 15_000, 0).otherwise(F.col("id") - 1).alias("other"))
    texts = spark.range(20_001).select("id", F.concat(F.lit("t"), "id").alias("text"))
    dealt, heads = substring_dedup.dealt_heads(pairs, texts)
    sides = dealt.join(heads, ["other", "part"])
    assert sides.count() == 20_000 and sides.filter("other_text <> concat('t', other)").isEmpty()
    most = dealt.groupBy("other", "part").count().agg(F.max("count")).first()[0]
    assert most <= 1.6 * max(substring_dedup.PAIRS, 20)
    assert heads.groupBy("other").count().filter("count > 1").collect()[0]["other"] == 0


@pytest.mark.parametrize("within", [False, True])
def test_windows_meet_the_first_of_their_key_and_large_keys_have_no_peers(spark, within):
    rng = np.random.default_rng(7)
    rows = {(-1, int(i), int(s)) for i, s in zip(rng.integers(0, 900, 25_000), rng.integers(0, 1 << 40, 25_000), strict=True)}
    rows |= {(int(k), int(i), int(s)) for k, i, s in zip(rng.integers(0, 4000, 9000), rng.integers(0, 50, 9000), rng.integers(0, 1 << 40, 9000), strict=True)}
    groups = {}
    for k, i, s in sorted(rows):
        groups.setdefault(k, []).append((i, s))
    met = {(k, 3 <= len(g) <= substring_dedup.PEERS, *x, *g[0]) for k, g in groups.items() if (len(g) > 1 if within else g[0][0] < g[-1][0]) for x in g}
    found = spark.createDataFrame(sorted(rows), "key long, id long, spot long").repartition(5)
    got = substring_dedup.written(substring_dedup.matches(found, found.count(), within), "met")
    assert {tuple(r) for r in got.collect()} == met and got.count() == len(met)
    few = {m[0] for m in met if m[1]}
    pairs = {(k, *x, *y) for k in few for x in groups[k] for y in groups[k][1:] if y[0] < x[0]}
    assert -1 not in few and {tuple(r) for r in substring_dedup.peers(got).collect()} == pairs


def joined_rows(spark, run):
    """The rows that all joins of the executions of run made, as Spark counts them."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before, total = store.executionsCount(), 0
    run()
    bus.waitUntilEmpty()
    every = store.executionsList()
    for e in range(before, every.size()):
        number = every.apply(e).executionId()
        counts, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())) if "Join" in node.name() else ():
                if m.name() == "number of output rows" and counts.contains(m.accumulatorId()):
                    total += int(counts.apply(m.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("large", [10_000, 20_000])
def test_each_window_of_a_large_key_passes_one_join_at_most(spark, large):
    rows = spark.range(large).selectExpr("-1L as key", "id", "id * 7 as spot").unionByName(spark.range(6000).selectExpr("id % 2000 as key", "id", "id as spot"))
    found = substring_dedup.written(rows.repartition(5, "id"), "windows")
    made = joined_rows(spark, lambda: substring_dedup.matches(found, large + 6000, False).write.format("noop").mode("overwrite").save())
    assert large <= made <= large + 6000


def test_passages_are_verified_without_the_windows_and_with_the_wanted_texts_alone(spark, monkeypatch):
    import os

    from samplewright.llm.common import shared_dir

    tables = lambda: {x for x in os.listdir(shared_dir(spark)) if x.startswith("window")}
    before, seen, dealt_heads = tables(), [], substring_dedup.dealt_heads

    def watched(pairs, texts):
        seen.append((tables() - before, {r["id"] for r in texts.collect()} - {r["other"] for r in pairs.collect()}))
        return dealt_heads(pairs, texts)

    monkeypatch.setattr(substring_dedup, "dealt_heads", watched)
    shared = " ".join(f"s{k}" for k in range(70))
    rows = [(1, shared), (2, f"a b {shared}"), (3, f"c {shared} d"), (4, "e f")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["id"], r["other_id"]) for r in got} >= {(2, 1), (3, 1)}
    assert seen and all(own == (set(), set()) for own in seen)


def test_ordered_windows_of_a_key_may_lie_in_many_batches():
    import pyarrow as pa

    rows = [(k, i, 10 * k + i) for k, n in ((-3, 1), (1, 9), (2, 2), (5, 1), (8, 40)) for i in range(n)]
    want = [(k, 3 <= n <= substring_dedup.PEERS, i, 10 * k + i, 0, 10 * k) for k, n in ((1, 9), (2, 2), (8, 40)) for i in range(n)]
    for size in (1, 2, 4, 7, 60):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[j : j + size], strict=True)], substring_dedup.NAMES) for j in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in substring_dedup.met_in_order(iter(parts), False) for r in b.to_pylist()] == want


def test_words_split_alike():
    text = "A\x0bb\x0c c d\x1ce f \r\n"
    assert text.encode().split() == [m.encode() for m in re.findall(r"[^\x20\x09-\x0D]+", text)]


def test_embedding_links_broadcast_no_table_that_grows(spark):
    """Of 3,000 vectors, 400 of them linked, at most the 1 / HOT_SHARE classes that can be hot go to the driver at once."""
    from samplewright.llm.common import HOT_SHARE

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[:400:2] = x[1:400:2] + rng.normal(size=(200, 32)) * 0.05
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "vec_id long, embedding array<double>").repartition(3)
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    numbers = lambda: {e.executionId() for e in map(store.executionsList().apply, range(store.executionsList().size()))}
    bus.waitUntilEmpty()
    before, sent = numbers(), []
    got = embedding_dedup.link(df).collect()
    bus.waitUntilEmpty()
    for number in numbers() - before:
        counts, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())) if node.name() == "BroadcastExchange" else ():
                if m.name() == "number of output rows" and counts.contains(m.accumulatorId()):
                    sent.append(int(counts.apply(m.accumulatorId()).replace(",", "")))
    assert max(sent, default=0) <= 1 / HOT_SHARE
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    linked = (np.triu(unit @ unit.T, 1) >= 0.9).sum()
    assert sum(r["n_links"] for r in got) >= 2 * 0.9 * linked >= 300
