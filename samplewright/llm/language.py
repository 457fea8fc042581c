"""Language ID with string kernels.

The kernel of two texts is the normalised number of character n-grams, of every
length from 1 to SPECTRUM, that both contain (a blended-spectrum presence
kernel; n-grams are hashed to DIMENSIONS places). Nyström landmarks map a text
to its kernel values with them, and one-versus-rest kernel ridge regression is
fitted on that map. A score is linear in the text's presence vector, so the
landmarks fold into one matrix and batches are scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPECTRUM = 3
DIMENSIONS = 1 << 16
#: Bounds of the fit: labelled rows, shared equally by the languages, and landmarks among them.
MAX_TRAINING_ROWS = 4000
MAX_LANDMARKS = 320
RIDGE = 1e-4
NONE = "und"
#: Texts, and characters, that are scored together.
BATCH_TEXTS, BATCH_CHARS = 32, 400_000
#: Dimensions that the fit unpacks together.
COLUMNS = 1 << 13

_letter: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each text, and whether it has a letter.

    Texts are lower-cased; runs without letters count as one space.
    """
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    table = _is_letter()
    for k, text in enumerate(texts):
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = table[code]
        if not letter.any():
            continue
        has[k] = True
        code = np.where(letter, code, np.uint32(32))
        code = np.concatenate(([np.uint32(32)], code[letter | np.append(True, letter[:-1])], [np.uint32(32)]))
        gram = np.zeros(len(code), np.uint32)
        for n in range(1, SPECTRUM + 1):
            gram = gram[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(1)
            h = gram * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out[k, (h * np.uint32(0x85EBCA77)) >> np.uint32(16)] = 1
    return out, has


@dataclass
class Model:
    """Languages and the matrix (DIMENSIONS x languages) that scores a normalised presence vector."""

    languages: list[str]
    weights: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [NONE] * len(texts), np.zeros(len(texts))
        rows, has = presence(texts)
        value = rows @ self.weights / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]
        best = value.argmax(axis=1)
        score = (np.clip(value[np.arange(len(texts)), best].astype(float), -1, 1) + 1) / 2
        return [self.languages[b] if ok else NONE for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def fit(rows: np.ndarray, languages: np.ndarray, landmarks: int = MAX_LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nyström kernel ridge regression on bit-packed presence rows."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32))
    # landmarks go round the languages in the order of the rows
    turn = pd.Series(languages).groupby(languages).cumcount().to_numpy()
    chosen = np.sort(np.argsort(turn, kind="stable")[:landmarks])
    length = np.sqrt(np.bitwise_count(rows).sum(axis=1, dtype=np.int64))
    kernel = np.zeros((len(rows), len(chosen)))
    stretches = [slice(b, b + COLUMNS // 8) for b in range(0, rows.shape[1], COLUMNS // 8)]
    for part in stretches:  # so that few rows are unpacked at a time
        marks = _unpacked(rows[chosen, part])
        for k in range(0, len(rows), 512):
            kernel[k : k + 512] += _unpacked(rows[k : k + 512, part]) @ marks.T
    kernel /= length[:, None] * length[chosen]
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    phi = kernel @ root
    right = phi.T @ (2.0 * (languages[:, None] == np.array(names)) - 1)
    w = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), right)
    of_marks = (root @ w / length[chosen, None]).astype(np.float32)
    return Model(names, np.concatenate([_unpacked(rows[chosen, part]).T @ of_marks for part in stretches]))


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def training_rows(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, most: int) -> DataFrame:
    """At most `most` labelled rows, as many of each language as there are or its equal share, by a hash of the id."""
    own = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = max(1, most // max(1, len(counts)))
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, (3 * share + 50) / n))) for k, n in sorted(counts.items())]) if counts else F.lit(1.0)
    h = F.xxhash64(F.lit("language"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    near = own.withColumn("h", h).filter(F.pmod("h", F.lit(1 << 30)) < rate * float(1 << 30)).filter(F.col("text").rlike(r"\p{L}"))
    w = Window.partitionBy("lang").orderBy("h", "id")
    return near.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= share).select("lang", "place", "h", "text")


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = MAX_TRAINING_ROWS) -> Model:
    """Fits on a sample of the rows that `learn` admits, bounded by `most` rows.

    Executors turn the sampled whole texts into bit vectors of DIMENSIONS bits;
    one task fits on those, at most `most` of them, and the driver gets the
    weights alone: DIMENSIONS numbers for each language.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(k, BATCH_TEXTS)
                packed = np.packbits(presence(part.column("text").to_pylist())[0].astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("place"), pa.array([x.tobytes() for x in packed], pa.binary())], ["lang", "place", "bits"])

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("place", "ascending"), ("lang", "ascending")])
        rows = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint8).reshape(-1, DIMENSIONS // 8)
        own = fit(rows, np.array(t.column("lang").to_pylist(), object))
        return pa.table([pa.array([own.languages]), pa.array([own.weights.tobytes()], pa.binary())], ["languages", "weights"])

    sample = training_rows(docs, learn, id_col, text_col, lang_col, most).mapInArrow(bits, "lang string, place int, bits binary")
    fitted = sample.groupBy(F.lit("model")).applyInArrow(solve, "languages array<string>, weights binary").first()
    if fitted is None:
        return Model([], np.zeros((DIMENSIONS, 0), np.float32))
    return Model(fitted["languages"], np.frombuffer(fitted["weights"], np.float32).reshape(DIMENSIONS, -1))


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (lang, score) of a whole text; null texts and texts without a letter are NONE with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    @F.pandas_udf("lang string, score double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for part in parts:
            langs, scores = [], []
            texts: list[str] = []
            chars = 0

            def flush():
                if texts:
                    a, b = own.predict(texts)
                    langs.extend(a)
                    scores.extend(b.tolist())
                    texts.clear()

            for t in part:
                t = t or ""
                if texts and (len(texts) == BATCH_TEXTS or chars + len(t) > BATCH_CHARS):
                    flush()
                    chars = 0
                texts.append(t)
                chars += len(t)
            flush()
            yield pd.DataFrame({"lang": langs, "score": scores})

    return of(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score), one row per input row.

    Learns from labelled rows that are not held out; predictions use the text
    alone. Without labelled rows, and for null texts and texts without a letter,
    the language is NONE and the score 0. Ties go to the language that sorts
    first. Repeated rows get equal results; other columns are not read.
    """
    model = train(docs, ~held_out(id_col), id_col, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), predicted(docs, model, text_col).alias("p"))
    return own.select("id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def language_documents(docs: DataFrame) -> DataFrame:
    """The documents that have a language, all columns as they were; NONE is rejected."""
    model = train(docs, ~held_out())
    return docs.filter(predicted(docs, model)["lang"] != NONE)
