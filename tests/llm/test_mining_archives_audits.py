"""Hard-negative mining, legacy archives and the filter audit."""

import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.llm import filter_audit, hard_negatives, warc
from samplewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc", "op13_filter_audit"])
def test_query_matches_sql(same_rows, name):
    same_rows(QUERIES[name], ORACLE_SQL[name])


# --- hard negatives ---


def brute_negatives(rows, positives=5, negatives=5):
    """rows: (id, label, v), without repeats."""
    out = []
    for i, label, v in rows:
        if i % 100:
            continue
        score = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, other, w in rows if j != i and len(w) == len(v)), key=lambda x: x[:2])
        for s, j, _ in [x for x in score if x[2]][:positives]:
            fits = [(-n, k) for n, k, same in score if not same and 80 * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, n) for r, (n, k) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>, score int, id string, h string, cell int")
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect())


def padded(rows):
    return [(*r, 1, "x", "y", 2) for r in rows]


@pytest.mark.parametrize(("d", "spread"), [(6, 3), (7, 40), (1, 2)])
def test_windows_are_exact_with_ties_hot_labels_and_copies(spark, monkeypatch, d, spread):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 5)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "FIRST", 30)
    rng = np.random.default_rng(d)
    centre = rng.integers(-spread, spread + 1, (6, d))
    rows = [(50 * i, int(rng.choice([0, 0, 0, 1, 2, 3])), (centre[i % 6] + rng.integers(-2, 3, d)).tolist()) for i in range(300)]
    rows += [(7 + 50 * i, 4, rows[0][2]) for i in range(60)]  # one vector that many rows hold, in one cell
    assert mined(spark, padded(rows)) == brute_negatives(rows)


def test_odd_rows_of_mining(spark):
    fine = [(0, 1, [5, 5]), (1, 1, [5, 4]), (2, 2, [4, 5]), (3, 2, [-5, -5]), (100, 3, [1, 2, 3]), (101, 3, [1, 2, 2]), (102, 4, [1, 2, 2]), (200, 5, []), (300, 9, [0, 0])]
    odd = [(4, None, [5, 5]), (5, 1, None), (6, 1, [5, None]), (None, 1, [5, 5])]
    got = mined(spark, padded([*fine, *odd, *fine[:3]]))
    assert got == brute_negatives(fine) and (0, 1, 1, 2, 45, 45) in got
    assert mined(spark, []) == [] and mined(spark, padded(fine[:1])) == []
    negative = [(0, 1, [-3, 0]), (1, 1, [3, 0]), (2, 2, [3, 0])]  # a negative positive score has no window
    assert mined(spark, padded(negative)) == []
    large = [(0, 1, [1 << 27, 3]), (1, 1, [1 << 27, 1]), (2, 2, [1 << 27, 2]), (3, 2, [(1 << 27) - 1, 2])]
    assert mined(spark, padded(large)) == brute_negatives(large)  # beyond what doubles hold
    with pytest.raises(ValueError, match="do not fit"):
        mined(spark, padded([(0, 1, [1 << 40]), (1, 1, [1])]))


def test_heap_visits_cells_downwards_and_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8)).round(1) * 10
    left, right = (hard_negatives.learn_codebook(p, 5) for p in (x[:, :4], x[:, 4:]))
    i, j = hard_negatives.nearest(x[:, :4], left), hard_negatives.nearest(x[:, 4:], right)
    rows, radii = np.zeros((5, 5), int), np.zeros((2, 5, 5))
    np.add.at(rows, (i, j), 1)
    for k, (centres, at, part) in enumerate(((left, i, x[:, :4]), (right, j, x[:, 4:]))):
        np.maximum.at(radii[k], (i, j), np.sqrt(((part - centres[at]) ** 2).sum(axis=1)))
    cells = hard_negatives.Cells(left, right, rows, radii, rows, rows)
    for q in x[:20]:
        seen = list(cells.visit(q))
        assert [c for *_, c in seen] and len({c for *_, c in seen}) == np.count_nonzero(rows)
        bounds = [b for b, *_ in seen]
        assert all(a >= b for a, b in itertools.pairwise(bounds))
        for bound, least, c in seen:
            own = x[i * 5 + j == c] @ q
            assert own.max() <= bound and own.min() >= least


# --- archives ---


def arc_file(version, records, gz=False):
    """records: (header line without its length, block)."""
    about = f"{version} 0 someone\n{warc.ARC_FIELDS[version]}\n\n".encode()
    rest = b"" if version == 1 else b" 200 - - 0 old.arc"
    raw = b"filedesc://old.arc 0.0.0.0 19970102030405 text/plain" + rest + b" %d\n" % len(about) + about
    parts = [raw, *(line + b" %d\n" % len(block) + block + b"\n" for line, block in records)]
    return b"".join(gzip.compress(p) for p in parts) if gz else b"".join(parts)


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_arc_records_by_version_and_length(monkeypatch, gz, piece):
    opened = warc.Stream.__init__
    monkeypatch.setattr(warc.Stream, "__init__", lambda self, content: opened(self, content, piece))
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nx\nhttp://a.b 1.2.3.4 20010101000000 text/html 99\n", b"", b"\n\n\n", "é\x00".encode()]
    one = [(f"http://a.b/ c{k}.html 1.2.3.4 2001010112000{k} text/html; charset=x".encode(), b) for k, b in enumerate(blocks)]
    got = list(warc.arc_records(arc_file(1, one, gz)))
    assert [r["block"] for r in got] == blocks and all(r["whole"] and r["version"] == 1 and r["archive"] == "old.arc" for r in got)
    assert [r["url"] for r in got] == [f"http://a.b/ c{k}.html" for k in range(4)] and got[2]["date"] == "2001-01-01T12:00:02Z" and got[0]["mime"] == "text/html; charset=x"
    two = [(f"dns:a{k} 1.2.3.4 200101011200 text/dns 404 abc - 5 f.arc".encode(), b) for k, b in enumerate(blocks)]
    got = list(warc.arc_records(arc_file(2, two, gz)))
    assert [r["block"] for r in got] == blocks and got[0]["url"] == "dns:a0" and got[0]["date"] == "2001-01-01T12:00:00Z" and got[0]["ip"] == "1.2.3.4"


def test_damaged_arc_lines_and_ends():
    raw = arc_file(1, [(b"http://a 1.1.1.1 99999999999999 text/html", b"abc")])
    junk = raw + b"no header here\nhttp://b 1.1.1.1 20010101000000 text/html 10\nshort"
    got = list(warc.arc_records(junk))
    assert [(r["url"], r["block"], r["whole"]) for r in got] == [("http://a", b"abc", True), ("http://b", b"short", False)]
    assert got[0]["date"] == "1997-01-02T03:04:05Z"  # the archive's own date
    with pytest.raises(ValueError, match="not an ARC"):
        list(warc.arc_records(b"WARC/1.0\n"))
    with pytest.raises(ValueError, match="version 3"):
        list(warc.arc_records(b"filedesc://x 0.0.0.0 19970102030405 text/plain 4\n3 0\n"))


def test_foreign_archives_become_warc(spark, tmp_path):
    html = [b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\nX-Page-Id: 7\r\n\r\n\xff\r\n\r", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n\xff\r\n\r", b"10.0.0.1"]
    (tmp_path / "arc").mkdir()
    for version, tail in ((1, b"text/html"), (2, b"text/html 200 - - 0 f")):
        name = f"http://v{version}.example/".encode()
        raw = arc_file(version, [(name + b" 1.2.3.4 20010203040506 " + tail, b) for b in html])
        (tmp_path / "arc" / f"{version}.arc.gz").write_bytes(gzip.compress(raw))
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    records = [r for p in (tmp_path / "warc").glob("*.gz") if (r := list(warc.warc_records(p.read_bytes())))]
    assert all(r[0][0]["warc-type"] == "warcinfo" for r in records)
    own = [(f, b) for r in records for f, b in r if f["warc-type"] != "warcinfo"]
    assert sorted(f["warc-type"] for f, _ in own) == ["resource", "response", *["revisit"] * 4]
    by_id = {f["warc-record-id"]: f for f, _ in own}
    assert len(by_id) == 6
    for f, b in own:
        assert f["warc-date"] == "2001-02-03T04:05:06Z" and f["warc-ip-address"] == "1.2.3.4"
        if f["warc-type"] == "revisit":
            to = by_id[f["warc-refers-to"]]
            assert to["warc-type"] != "revisit" and to["warc-payload-digest"] == f["warc-payload-digest"] and to["warc-target-uri"] == f["warc-refers-to-target-uri"]
        else:
            payload = b[-4:] if b.startswith(b"HTTP") else b
            assert f["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    rows = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert len(rows) == 6 and all(r["intact"] for r in rows) and {r["payload_bytes"] for r in rows} == {4, 8}


def brute_pages(rows, least=0):
    top = {}
    for i, h in rows:
        p = (h or "").encode()
        if len(p) >= least:
            top.setdefault(p, []).append(i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        best = max((x for x in top.get(p, [i]) if x is not None), default=None)
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == best else "revisit", None if i == best else best))
    return out


@pytest.mark.parametrize("least", [0, 3])
def test_pages_through_archives(spark, least):
    long = "WARC/1.1\r\n\r\n" * 60_000
    html = [None, "", "", "é\r\n\r\n", "é\r\n\r\n", "ab", "ab", long, "\x00\x01", "x 1.1.1.1 20010101000000 text/html 5\nabc", *["hot"] * 300]
    rows = [(i * 3 - 6, u, h, "s", 1) for i, (u, h) in enumerate(zip(itertools.cycle([None, "http://a/b c\td", "", "ftp://é"]), html, strict=False))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, offset int").repartition(5)
    got = sorted(tuple(r) for r in warc.converted(df, least).collect())
    assert got == sorted(brute_pages([(r[0], r[2]) for r in rows], least), key=lambda x: x[0])


def test_pages_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a", "x"), (None, None, "y"), (5, "a", "x"), (5, "a", "x"), (4, "a", "x")], "page_id long, url string, html string")
    got = [tuple(r)[:1] + tuple(r)[3:] for r in warc.converted(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "revisit", 5), (None, "response", None), (5, "response", None), (5, "revisit", 5), (4, "revisit", 5)], key=str)
    assert warc.converted(df.limit(0)).count() == 0


# --- filter audit ---


def brute_audit(docs, labels):
    """docs: (id, text, part)."""
    texts, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        texts.setdefault(t or "", []).append(i)
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    parts = {}
    for i, t, part in docs:
        t = t or ""
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = i is not None and any(j is not None and j < i for j in texts[t])
        parts.setdefault(part or "", []).append((frozenset(k for k, v in fails.items() if v), i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = (f, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
        for key, v in out.items():
            if key[0] == part:
                out[key] = (*v, shapley[v[0]])
    return {k: v[1:] for k, v in out.items()}


@pytest.mark.parametrize("range_rows", [3, 1 << 17])
def test_audit_of_odd_documents(spark, monkeypatch, range_rows):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", range_rows)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(80)]
    texts = [None, "", " \t\n", "A", "a|b", "É" * 30, "one two " * 40, " ".join(words), " ".join(words) + " $", " ".join(words).upper(), "x " * 90_000]
    docs = [(i, rng.choice(texts), rng.choice(["hot", "hot", "hot", None, "", "é"])) for i in range(120)]
    docs += [(3, texts[6], "hot"), (3, texts[7], "hot"), (3, texts[7], "hot"), (None, texts[6], "é"), (None, None, "alone")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "b", "p") for d in docs], "doc_id long, text string, source string, bits int, same string, part string").repartition(5)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r)[3:] for r in filter_audit.audit_documents(df, said).collect()}
    assert got == brute_audit(docs, labels)
    assert len(got) == 600 * 4
    assert filter_audit.audit_documents(df.limit(0), said).count() == 0
    assert {v[4:6] for v in (tuple(r)[3:] for r in filter_audit.audit_documents(df, said.limit(0)).collect())} == {(0, 0)}


def test_galloping_merge_equals_sets():
    rng = np.random.default_rng(2)
    for step in (1, 3, 64, 4096):
        lists = [np.unique(rng.integers(0, hi, n)).astype(np.int32) for hi, n in ((50, 30), (5000, 400), (100_000, 50), (9, 0), (10, 10), (200_000, 3))]
        values, held = (np.concatenate(c, axis=-1) for c in zip(*filter_audit.merged(lists, step), strict=True))
        assert values.tolist() == sorted(set(np.concatenate(lists).tolist()))
        assert all(values[h].tolist() == x.tolist() for h, x in zip(held, lists, strict=True))
        sizes = filter_audit.union_sizes(lists[:3], lists[3:5])
        for s in range(8):
            union = set().union(*(lists[k].tolist() for k in range(3) if s >> k & 1))
            assert sizes[s].tolist() == [len(union), *(len(union & set(m.tolist())) for m in lists[3:5])]
    a = np.sort(rng.integers(0, 1000, 200))
    assert all(filter_audit.gallop(a, s, e) == s + np.searchsorted(a[s:], e) for s in (0, 5, 199) for e in (0, 1, 500, 1001))
