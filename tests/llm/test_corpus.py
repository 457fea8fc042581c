"""Sharding, packing, language ID, licences, token counts, mixing and the pipeline."""

import itertools
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.llm import language, licences, mixing, packing, sharding, token_counts, tokens
from samplewright.llm.licence_texts import NOTICES, TEXTS
from samplewright.llm.queries import OP10_SQL, ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, rank int, part string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "lang wort " * 30_000
    texts = [None, "", " \t", "one", "one", long, "été déjà vu", "日本語 テキスト", "12 34 !?", "<|endoftext|> x", "x\x1cy z"]
    rows = [(i, t, ["en", None, "fr"][i % 3], ["b", None, "a", "é"][i % 4], None, "x", 1, 2, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "nobody", None, None, None, None, None, None, None)], SCHEMA)


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_hilbert_neighbours_differ_in_one_step(spark, n, bits):
    df = spark.range(1 << (n * bits))
    axes = [F.shiftright("id", i * bits).bitwiseAND((1 << bits) - 1) for i in range(n)]
    rows = sorted(tuple(r) for r in df.select(sharding.hilbert_index(axes, bits).alias("h"), *[a.alias(f"x{i}") for i, a in enumerate(axes)]).collect())
    assert [r[0] for r in rows] == list(range(1 << (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(u[1:], v[1:], strict=True)) == 1 for u, v in zip(rows, rows[1:], strict=False))


def check_shards(rows, most):
    total = sum(r["size"] for r in rows)
    for s in range(8):
        own = sorted((r["slot"], r["size"]) for r in rows if r["shard"] == s)
        assert [x for x, _ in own] == list(range(len(own)))
        assert abs(sum(x for _, x in own) - total / 8) <= most


def test_shards_have_near_equal_bytes(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op1_hilbert_shards"](spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)
    check_shards(rows, max(r["size"] for r in rows))
    order = sorted((r["shard"], r["slot"], r["hilbert"]) for r in rows)
    assert [h for *_, h in order] == sorted(h for *_, h in order)


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.shard_documents(odd).collect()
    assert len(rows) == odd.count() and {r["id"]: r["size"] for r in rows}[0] == 1
    check_shards(rows, max(r["size"] for r in rows))
    assert sharding.shard_documents(odd.limit(0)).count() == 0


def test_a_text_that_many_rows_share_is_cut_by_id(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(i, "hot" if i % 3 else f"t{i % 50}", "a", "en") for i in range(600)] + [(None, "hot", "a", "en")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.shard_documents(df).collect()
    assert len(got) == 630
    check_shards(got, max(r["size"] for r in got))
    place = sorted((r["shard"], r["slot"], r["hilbert"], r["text_crc32"]) for r in got)
    runs = [k for k, _ in itertools.groupby(x[2:] for x in place)]
    assert len(runs) == len(set(runs))  # equal texts of a cell are neighbours


def test_long_names_get_cells_of_their_own(spark):
    names = [f"https://www.example.com/very/long/common/path/{k % 16:02}/tail" for k in range(1600)] + [None] * 10
    df = spark.createDataFrame(list(enumerate(names)), "doc_id long, host string").withColumn("one", F.lit(1).cast("long"))
    got = sharding.hilbert_shards(df, {"host": F.col("host"), "host2": F.col("host")}, F.col("one"), F.col("doc_id"), n_shards=4, extra={"host": F.col("host")}).collect()
    cells = {}
    for r in got:
        cells.setdefault(r["hilbert"], set()).add(r["host"])
    assert len(cells) == 16 and all(len(x - {None}) == 1 for x in cells.values())  # null shares the lowest


def test_written_shards_have_the_number_asked_for(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("a"), F.lit(1).cast("long").alias("one"))
    placed = sharding.hilbert_shards(df, {"a": F.col("a")}, F.col("one"), F.col("doc_id"), n_shards=11)
    sharding.write_shards(df, placed, f"{tmp_path}/out", n_shards=11)
    assert {r["shard"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().collect()}.keys() == set(range(11))
    with pytest.raises(ValueError, match="not unique"):
        sharding.write_shards(df, placed.unionByName(placed), f"{tmp_path}/twice", n_shards=11)


def test_shards_prune_on_every_dimension(spark):
    df = spark.range(4096).select(F.col("id").alias("doc_id"), (F.xxhash64("id") % 1000).alias("a"), (F.xxhash64("id", F.lit(1)) % 1000).alias("b"))
    dims = {"a": F.col("a"), "b": F.col("b")}
    placed = sharding.hilbert_shards(df, dims, F.lit(1).cast("long"), F.col("doc_id"), n_shards=16)
    spans = sharding.shard_ranges(df, placed, dims).select(F.avg(F.col("max_a") - F.col("min_a")), F.avg(F.col("max_b") - F.col("min_b"))).first()
    assert max(spans) < 0.45 * 2000


def test_word_encoder_equals_the_tokenizer(spark, data):
    own = tokens.WordBpe(tokens.tokenizer_path("word_bpe_49k.json"), room=2000)
    assert own.plain
    odd = ["", " ", "İstanbul ǅ", "Don't<|endoftext|>x", "a\x1cb", "x²y ½ 3 ª", "ÀÉÎ ſt ŉ ß ẞ", "naïve—x", "''s's't're 'Re", "日本語", "a" * 5000, "ʼn Ǆ ǰ ŀ", "é o"]
    texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    for t in [*odd, *texts]:
        assert own.encode(t) == own._whole(t), t[:50]


def best_fit_loop(lengths, size, most):
    """The same rule without a bitset."""
    free, out, n = {}, [], 0
    for x in lengths:
        fits = [(f, b) for b, f in free.items() if f >= x]
        if fits:
            space = min(f for f, _ in fits)
            own = max(b for f, b in fits if f == space)
        else:
            if len(free) == most:
                del free[max(b for b, f in free.items() if f == min(free.values()))]
            own, n = n, n + 1
            free[own] = size
        out.append((own, size - free[own]))
        free[own] -= x
        if not free[own]:
            del free[own]
    return out


def test_best_fit_rule():
    rng = np.random.default_rng(0)
    for most in (1, 3, 50):
        lengths = rng.integers(1, 65, 500).tolist()
        own, loop = packing.BestFit(64, most), best_fit_loop(lengths, 64, most)
        got = [own.place(x) for x in lengths]
        assert [o for _, o in got] == [o for _, o in loop] and own.bins == len({b for b, _ in loop})


def check_packing(rows, size=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size
    return len(bins), sum(r["length"] for r in rows)


def test_packing_of_the_table(spark, data):
    from tokenizers import Tokenizer

    rows = QUERIES["op2_best_fit_packing"](spark, data).collect()
    n, total = check_packing(rows)
    assert n <= 1.03 * -(-total // 2048) + 1
    hf, by = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json")), {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = np.array([*hf.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, min(2048, len(ids) - s)) for k, s in enumerate(range(0, len(ids), 2048))]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)


def test_packing_of_odd_rows_and_round_trip(spark, odd):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows)
    assert {r["id"] for r in rows} == {None, *range(11)} and sum(r["id"] == 3 for r in rows) == 2
    own = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    placed = packing.pack_documents(own)
    seqs = packing.sequences(own, placed).collect()
    assert sum(len(r["ids"]) for r in seqs) == sum(r["length"] for r in placed.collect()) and max(len(r["ids"]) for r in seqs) <= 2048
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, data).join(docs, "doc_id").filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] <= got[2] <= 1


def test_folded_scores_equal_landmark_kernels():
    texts = ["the cat sat", "le chat noir", "the dog ran", "la vache rit", "a dog sat there", "un chien court"]
    rows, _ = language.presence(texts)
    langs = np.array(["en", "fr"] * 3, object)
    model = language.fit(np.packbits(rows.astype(bool), axis=1), langs, landmarks=6, ridge=1e-9)
    unit = rows / np.sqrt(rows.sum(1))[:, None]
    k = unit.astype(float) @ unit.T  # all rows are landmarks: Nystroem is exact, ridge regression interpolates
    want = k @ np.linalg.solve(k + 6e-9 * np.eye(6), 2.0 * (langs[:, None] == np.array(["en", "fr"])) - 1)
    assert np.allclose(unit @ model.weights, want, atol=1e-2)
    assert model.predict(["", "123 !", "the"])[0][:2] == ["und", "und"]


def test_language_of_odd_rows(spark, odd):
    by = {r["id"]: r for r in language.identify(odd).collect()}
    assert len(by) == 12 and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2, 8))
    assert by[5]["lang_pred"] in ("en", "fr") and by[None]["held_out"] is False
    kept = language.language_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 9, 10, None}
    none = language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_licences_match_sql(same_rows):
    same_rows(QUERIES["op8_licence_scan"], ORACLE_SQL["op8_licence_scan"])


def test_licence_variants(spark):
    texts = [(i, "Copyright (c) 2020 A. Body\n" + t.upper().replace("\n", "\r\n").replace(",", " ;")) for i, (_, t) in enumerate(TEXTS)]
    texts += [(100, TEXTS[0][1].replace("Permission", "Permision")), (101, None), (102, ""), (103, "x\n  * released under the MIT Licence!\ny"), (104, "no licence")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("licence", F.lit(1))
    by = {r["id"]: r for r in licences.scan(df).collect()}
    assert all(by[i]["licence"] == name for i, (name, _) in enumerate(TEXTS))
    assert by[100]["licence"] is None and by[101]["canonical_sha256"] is None and by[102]["licence"] is None
    assert by[103]["notices"] == ["MIT"] and by[104]["notices"] == []
    assert licences.scan(df.limit(0)).count() == 0
    line = spark.createDataFrame([(i, f"a b\n{t}") for i, (_, t) in enumerate(NOTICES)], "doc_id long, text string")
    assert {r["id"]: r["notices"] for r in licences.scan(line).collect()} == {i: [k] for i, (k, _) in enumerate(NOTICES)}


@pytest.mark.parametrize("line", ["Copyright The Foo Authors", "Copyright Jane Doe 2020", "Copyright: The Foo Authors.", "# Copyright (c) 2020, A. Body", "(c) Jane Doe, 2021", "© A. Body", "Copyright", "(C) Copyright A. Body", "All rights reserved."])
def test_copyright_lines_are_set_aside(spark, line):
    wrapped = {k: t.replace(" copyright notice", "\ncopyright notice").replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS") for k, t in TEXTS}
    rows = [(i, f"{line}\n\n{t}") for i, t in enumerate(wrapped.values())]
    got = {r["id"]: r["licence"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(wrapped))


COMMON = Path("/usr/share/common-licenses")
FILES = {"Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0"}


@pytest.mark.skipif(not (COMMON / "GPL-3").exists(), reason="the system has no folder of licences")
def test_digests_are_those_of_whole_licences(spark):
    rows, want = [], []
    for f in ("Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "LGPL-2.1", "MPL-1.1", "MPL-2.0", *FILES):
        text = (COMMON / f).read_text()
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        for own in {text, terms + end, terms}:
            want += [FILES.get(f, f)] * 2 + [None]
            rows += [own, "© 2020 A. Body\n" + own.upper().replace(",", " ,"), own.replace("the", "teh")]
    got = {r["id"]: r["licence"] for r in licences.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert {k for k, _ in licences.DIGESTS} == set(want) - {None}


def test_planted_licences_match_sql_through_the_query(spark, same_rows, tmp_path):
    import duckdb

    rows = [(i, f"Copyright {i} The Foo Authors\n{t}") for i, (_, t) in enumerate(TEXTS)]
    rows += [(100 + i, f"{'x ' * 300}\n{t}\n{'y ' * 3000}") for i, (_, t) in enumerate(NOTICES)]
    rows += [(900, None), (901, ""), (902, "the copyright notice\nis here"), (902, "the copyright notice\nis here"), (903, "(c) 2020 nobody")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op8_licence_scan"](spark, str(tmp_path)).select("doc_id", "canonical_sha256", "licence", "notices").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, canonical_sha256, licence, notices FROM ({ORACLE_SQL['op8_licence_scan']})").fetchall(), key=repr)
    assert sorted(got, key=repr) == want
    assert {r[2] for r in got if r[0] < 100} == {k for k, _ in TEXTS} and all(r[3] for r in got if 100 <= r[0] < 900)


def test_licence_plan_is_native(spark, odd):
    plan = licences.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_token_table_answers_every_limit(spark):
    n = np.random.default_rng(0).integers(0, 3000, 800)
    table = token_counts.length_table(spark.createDataFrame([(int(x),) for x in n], "n_tokens long"), limits=(100, 5000)).cache()
    for r in table.collect():
        c = r["context_limit"]
        assert (r["docs_within"], r["tokens_within"], r["docs_over"], r["truncated_tokens"]) == ((n <= c).sum(), n[n <= c].sum(), (n > c).sum(), np.minimum(n, c).sum())
    for c in (0, 1, 777, 10**6):
        assert token_counts.truncated_total(table, c).first()["truncated_tokens"] == np.minimum(n, c).sum()
    for r in token_counts.quantiles(table, [0.0, 0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == np.sort(n)[max(int(np.ceil(r["share"] * len(n))), 1) - 1]
    assert {r["truncated_tokens"] for r in token_counts.length_table(spark.createDataFrame([], "n_tokens long")).collect()} == {0}


def test_encoded_lengths(spark, odd):
    import public_tokenizers as p

    encode = tokens.byte_bpe(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    got = token_counts.encoded_lengths(odd).collect()
    assert len(got) == odd.count() and all(r["n_tokens"] == len(encode(texts[r["id"]] or "")) for r in got)


def test_token_query_against_the_public_tokenizer(spark, tmp_path):
    import public_tokenizers as p
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    own = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=load_tiktoken_bpe(p.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = [None, "", " ", "a", "a", "été déjà vu", "日本語 テキスト 123", "word " * 400, "x" * 3000, "line\n\n  more\ttabs", "<|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)) + [(3, "a"), (None, "b c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = np.array([len(own.encode_ordinary(t or "")) for t in [*texts, "a", "b c"]])
    rows = QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()
    assert {r["context_limit"] for r in rows} == set(n) | set(token_counts.LIMITS)
    for r in rows:
        c = r["context_limit"]
        assert (r["docs"], r["docs_within"], r["tokens_within"], r["docs_over"], r["tokens_over"]) == ((n == c).sum(), (n <= c).sum(), n[n <= c].sum(), (n > c).sum(), n[n > c].sum())
        assert r["truncated_tokens"] == np.minimum(n, c).sum() and r["n_docs"] == len(n) and r["n_tokens"] == n.sum()


def test_mixed_documents_are_the_copies_that_mix_decides(spark):
    rows = [(i if i >= 0 else None, " ".join(["w"] * (3 + i % 5)), "en", "abc"[i % 3], k) for i in range(-1, 60) for k in range(3)]
    df = spark.createDataFrame(rows + [rows[0]] * 5, "doc_id long, text string, lang string, source string, _mix int")
    want, got = {}, {}
    for r in mixing.mix(df).collect():
        want[r["id"], r["size"]] = want.get((r["id"], r["size"]), 0) + r["copies"]
    out = mixing.mix_documents(df)
    for r in out.collect():
        key = r["doc_id"], len(r["text"].split())
        got[key] = got.get(key, 0) + 1
    assert out.columns == df.columns and got == {k: v for k, v in want.items() if v}


def test_one_of_repeated_rows_stays(spark):
    from samplewright.llm import exact_dedup, jaccard_join

    rows = [(i % 4, f"a b c d e f {i % 4}", "en", "s", i) for i in range(12)] + [(None, "g h i j k l", "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key0 int")
    exact = exact_dedup.dedup_documents(df)
    assert exact.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in exact.collect() if r["doc_id"] is not None) == [(i, f"a b c d e f {i}") for i in range(4)]
    assert exact.filter("doc_id is null").count() == 1
    assert sorted(r["doc_id"] for r in jaccard_join.near_dedup_documents(df.filter("doc_id is not null")).collect()) == [0, 1, 2, 3]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from samplewright.llm.common import shared_dir

    def session(master, **conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x"})) == "hdfs://x"
    assert shared_dir(session("local[4]"))


def test_mix_matches_sql(same_rows):
    same_rows(QUERIES["op10_mix"], OP10_SQL)


def loop_targets(sizes):
    """Targets by resharing the excess until none is above its cap; sizes in code-point order, null last."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    target, capped, total = [0.0] * len(sizes), set(), sum(sizes)
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        free = sum(weight[i] for i in range(len(sizes)) if i not in capped)
        target = [3 * s if i in capped else left * weight[i] / free if free else 0 for i, s in enumerate(sizes)]
        more = {i for i in range(len(sizes)) if i not in capped and target[i] > 3 * sizes[i]}
        if not more:
            return target
        capped |= more


@pytest.mark.parametrize("sizes", [[10, 1000, 500, 3, 0, 70], [1, 1, 1], [0, 0], [5], [1, 10**6], [900, 1, 1, 1, 1, 1, 800]])
def test_targets_by_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i:02}" if i < len(sizes) - 1 else None, s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("code").collect()]
    assert np.allclose(got, loop_targets(sizes))


def test_mix_is_near_its_targets(spark, data):
    rows = QUERIES["op10_mix"](spark, data).collect()
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and {r["id"]: r["size"] for r in rows}[0] == 0
    again = mixing.mix(odd.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mixing.mix_documents(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_work(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mix", "pack"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stage(spark, docs, data).cache()
        if name == "language_id":
            lettered = {r["doc_id"] for r in given.collect() if any(c.isalpha() for c in r["text"] or "")}
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(lettered)
        if name == "mix":
            copies = {r["id"]: r["copies"] for r in mixing.mix(given).collect() if r["copies"]}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == copies
        if name == "pack":
            check_packing(docs.collect())
            continue
        assert docs.columns == columns
        texts = [r["text"] for r in docs.collect()]
        if name == "exact_dedup":
            squeezed = ["".join(t.translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))) for t in texts]
            assert len(squeezed) == len(set(squeezed)) and 0.8 * before < len(squeezed) <= before
        if name == "jaccard_join":
            w = [t.encode().lower().split() for t in texts]
            sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in w]
            assert all(100 * len(a & b) < 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a and b)
    assert corpus_pipeline.run(spark, data).count() == docs.count()


def test_stages_with_clashing_names(spark, data):
    import corpus_pipeline

    odd = {n: F.lit(1) for n in ("_mix", "_mix_id", "_kept_id", "_language", "_key0", "_key1", "_times", "id", "size", "copies", "digest")}
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60").withColumns(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        assert out.count() > 0 and (name == "pack" or out.columns == docs.columns)
        docs = out


def test_stages_of_an_empty_table(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0
