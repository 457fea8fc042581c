"""Encoding whole texts with the public tokenizers, inside Arrow batches."""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are turned into Python strings at a time.
SLICE = 256


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[list[str]]:
    """The column's strings, null as empty, a slice at a time."""
    own = batch.column(column)
    for k in range(0, len(own), SLICE):
        yield [t or "" for t in own.slice(k, SLICE).to_pylist()]


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level alphabet stands for: printable
    ones for themselves, the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class WordBpe:
    """Ids of a word-level BPE tokenizer as little-endian 32-bit bytes.

    This tokenizer lower-cases, drops white space and never merges across it, so
    a text of plain Latin script is the concatenation of its space-free chunks.
    Chunks repeat; their ids are kept in a bounded table. New chunks are cut into
    words by the tokenizer's own pattern and encoded together as ranks of byte
    strings: MARK stands for the end of a word, the merges of a byte with MARK
    come first, then the tokenizer's merges in their order. A text with any
    character outside that script, or that may hold a special token, goes through
    the tokenizer as a whole.
    """

    #: Characters for which lower-casing and white space mean the same here and in the tokenizer.
    OTHER = re.compile("[^\t-\r -~¡-įı-ɏ]")
    MARK = "\x01"  # not in the set above
    PROBE = "Some words, don't; 12 of them: naïve été über-straße señor's (x) ... outreaitre!"

    def __init__(self, path: str, room: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.own, self.room, self.known = Tokenizer.from_file(path), room, {}
        letters, digits = (_class(k) for k in "LN")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model.get("end_of_word_suffix")
        self.plain = model.get("type") == "BPE" and bool(end)
        if not self.plain:
            return
        byte, vocab = _byte_of(), model["vocab"]
        ranks: dict[bytes, int] = {}
        ids: list[int] = []

        def add(token: str, raw: bytes) -> None:
            if token in vocab and raw not in ranks:
                ranks[raw] = len(ids)
                ids.append(vocab[token])

        for tail, mark in (("", b""), (end, self.MARK.encode())):
            for c, b in byte.items():
                add(c + tail, bytes([b]) + mark)
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            token, last = a + b, b.endswith(end)
            add(token, bytes(byte[c] for c in (token[: -len(end)] if last else token)) + self.MARK.encode() * last)
        self.ranks = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]+{self.MARK}", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, "<u4")
        self.ends = np.zeros(len(ids), bool)
        self.ends[[r for raw, r in ranks.items() if raw.endswith(self.MARK.encode())]] = True
        self.plain = self.encode(self.PROBE) == self._whole(self.PROBE)
        self.known.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > self.room:
            self.known.clear()
        words = [self.words.findall(c) for c in chunks]
        flat = [w for own in words for w in own]
        got = np.array(self.ranks.encode_ordinary(self.MARK.join(flat) + self.MARK), np.int64) if flat else np.empty(0, np.int64)
        stop = np.concatenate(([0], np.flatnonzero(self.ends[got]) + 1))  # after each word
        at = 4 * stop[np.cumsum([0, *map(len, words)])]
        ids = self.ids[got].tobytes()
        self.known.update((c, ids[i:j]) for c, i, j in zip(chunks, at[:-1].tolist(), at[1:].tolist(), strict=True))

    def encode(self, text: str) -> bytes:
        if not self.plain or self.OTHER.search(text) or "<|" in text:
            return self._whole(text)
        chunks = text.lower().split()
        parts = list(map(self.known.get, chunks))
        if None in parts:
            new = list(dict.fromkeys(c for c, p in zip(chunks, parts, strict=True) if p is None))
            self._learn(new)
            for k, p in enumerate(parts):
                if p is None:
                    parts[k] = self.known[chunks[k]]
        return b"".join(parts)


def _class(category: str) -> str:
    """Regex ranges of the Latin characters in a Unicode category."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == category)


_encoders: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One encoder a worker process: its table of chunks outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordBpe(path)
    return _encoders[path]


def byte_bpe(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE given as ranks; special strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def encoded_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, most: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every document's ids plus end_id, cut into pieces of `most` where it is longer:
    (id, piece, start, length, ids_crc32[, ids])."""
    end = np.array([end_id], "<u4").tobytes()
    id_type = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            row, out = 0, []
            for texts in texts_of(batch, "text"):
                for text in texts:
                    ids = bpe.encode(text) + end
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, most)):
                        own = ids[4 * at : 4 * (at + most)]
                        out.append((row, k, at, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                    row += 1
            rows, piece, start, length, crc, ids = zip(*out, strict=True) if out else [()] * 6
            cols = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
