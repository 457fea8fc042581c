"""Licence lookup by canonical digest, in DataFrame functions only.

A text is made canonical (case, punctuation, copyright lines and equivalent
spellings), digested, and hash-joined to the digests of known licence texts.
Its lines are looked up among known one-line notices in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import DIGESTS, NOTICES, SPELLINGS, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n"
#: Where a licence's own sentence, wrapped before "copyright", goes on.
OWN_WORDS = r"copyright([ \t]+(?:notice|holder|owner|licen|law|statement|interest|protection|disclaimer|and|or|in|on|as)[a-z]*\b)"
#: A line that states a copyright, or reserves all rights, and nothing of the licence.
COPYRIGHT = r"^[^a-z0-9\n]*(?:copyright(?:[^a-z0-9_\n][^\n]*|[0-9][^\n]*)?|\(c\)[ \t]*(?:copyright|[0-9])[^\n]*|\(c\)[^\n]*[0-9]{4}[^\n]*|©[^\n]*)$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
MARKS = r"[^\p{L}\p{N}\n]+"
BREAKS = r" ?\n[ \n]*"
SPELT = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def canonical(text: Column) -> Column:
    """Lower case, words parted by one space, lines by one line feed; null stays null."""
    out = F.translate(text, UPPER, LOWER)
    out = F.when(F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("rights reserved")), F.regexp_replace(F.regexp_replace(out, OWN_WORDS, "copyright_$1"), "(?md)" + COPYRIGHT, "")).otherwise(out)
    out = F.trim(F.regexp_replace(out, MARKS, " "))
    out = F.regexp_replace(out, BREAKS, "\n")
    spelt = out
    for a, b in SPELLINGS:
        spelt = F.regexp_replace(spelt, rf"\b{a}\b", b)
    return F.trim(F.when(out.rlike(SPELT), spelt).otherwise(out))


def flat(canon: Column) -> Column:
    return F.trim(F.translate(canon, "\n", " "))


def known(spark, entries: Sequence[tuple[str, str]], digests: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(known_digest, licence) of the given texts and digests; as many rows as distinct canonical texts."""
    df = spark.createDataFrame(list(entries), "licence string, text string").select("licence", F.sha2(flat(canonical(F.col("text"))), 256).alias("known_digest"))
    df = df.unionByName(spark.createDataFrame(list(digests), "licence string, known_digest string"))
    return df.groupBy("known_digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: Sequence[tuple[str, str]] = TEXTS, notices: Sequence[tuple[str, str]] = NOTICES, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """Looks every whole text, and each of its lines, up among known licences.

    Returns (id, canonical_sha256, licence, notices), one row per input row:
    licence is that of which the whole text is a copy, or null; notices are the
    licences that its lines name, distinct and sorted, empty if none. A null
    text has a null digest and no licence; an empty text is not a licence. The
    known texts are given, or the digests of their canonical forms, so these are
    broadcast whatever the size of docs; no row of docs is shuffled. Other
    columns are not read.
    """
    spark = docs.sparkSession
    canon = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon"))
    lines = {r["known_digest"]: r["licence"] for r in known(spark, notices).collect()}  # the notices given above
    named = F.create_map(*[F.lit(x) for kv in sorted(lines.items()) for x in kv]) if lines else F.create_map().cast("map<string,string>")
    given = spark.createDataFrame(list(notices), "licence string, text string")
    longest = given.agg(F.coalesce(F.max(F.length(flat(canonical(F.col("text"))))), F.lit(0))).first()[0]  # no longer line has the digest of one
    hits = F.transform(F.filter(F.split("canon", "\n"), lambda x: F.length(x) <= longest), lambda x: named[F.sha2(x, 256)])
    rows = canon.select(
        "id",
        F.sha2(flat(F.col("canon")), 256).alias("canonical_sha256"),
        F.coalesce(F.array_sort(F.array_distinct(F.array_compact(hits))), F.array().cast("array<string>")).alias("notices"),
    )
    table = known(spark, texts, digests)
    return rows.join(F.broadcast(table), rows["canonical_sha256"] == table["known_digest"], "left").select("id", "canonical_sha256", "licence", "notices")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The same canonical form as SQL."""
    out = f"translate({text}, {_sql(UPPER[:-1])} || chr(13), {_sql(LOWER[:-1])} || chr(10))"
    out = f"regexp_replace({out}, {_sql(OWN_WORDS)}, {_sql('copyright_' + chr(92) + '1')}, 'g')"
    out = f"regexp_replace({out}, {_sql('(?m)' + COPYRIGHT)}, '', 'g')"
    out = f"trim(regexp_replace({out}, {_sql(MARKS)}, ' ', 'g'), ' ')"
    out = f"regexp_replace({out}, {_sql(BREAKS)}, chr(10), 'g')"
    for a, b in SPELLINGS:
        out = f"regexp_replace({out}, {_sql(rf'\b{a}\b')}, {_sql(b)}, 'g')"
    return f"trim({out}, ' ')"


def scan_sql(texts: Sequence[tuple[str, str]] = TEXTS, notices: Sequence[tuple[str, str]] = NOTICES, digests: Sequence[tuple[str, str]] = DIGESTS) -> str:
    def values(entries: Sequence[tuple[str, str]]) -> str:
        return ", ".join(f"({_sql(k)}, {_sql(t)})" for k, t in entries)

    digest = f"sha256(trim(replace({canonical_sql('text')}, chr(10), ' '), ' '))"
    return f"""
WITH whole AS (SELECT d, min(licence) AS licence FROM
        (SELECT {digest} AS d, licence FROM (VALUES {values(texts)}) AS v(licence, text) UNION ALL VALUES {", ".join(f"({_sql(d)}, {_sql(k)})" for k, d in digests)}) GROUP BY 1),
line AS (SELECT {digest} AS d, min(licence) AS licence FROM (VALUES {values(notices)}) AS v(licence, text) GROUP BY 1),
doc AS (SELECT doc_id, {canonical_sql('text')} AS canon FROM documents),
hit AS (SELECT doc_id, list_sort(list(DISTINCT licence)) AS notices
        FROM (SELECT doc_id, unnest(string_split(canon, chr(10))) AS l FROM doc) JOIN line ON sha256(l) = d GROUP BY doc_id)
SELECT doc.doc_id, sha256(trim(replace(canon, chr(10), ' '), ' ')) AS canonical_sha256, licence,
       coalesce(array_to_string(notices, ','), '') AS notices
FROM doc LEFT JOIN whole ON sha256(trim(replace(canon, chr(10), ' '), ' ')) = d LEFT JOIN hit ON doc.doc_id = hit.doc_id
"""
