"""Byte-level BPE by the tiktoken library over a local rank file.

Long or irregular texts are cut at boundaries that no match of the split pattern crosses (a non-space before white space,
a letter or digit before another class), so that the ids of the parts are the ids of the whole. White-space runs too long
for the regex engine are encoded as the one match that they are. Decoding joins raw token bytes: no UTF-8 repair.

Defined cases: a null text is encoded as an empty one; an empty text has no ids; equal rows give equal rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyveil.llm.shared import documents

#: The white space of the split pattern's engine; cut points that no match crosses.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9!-/:-@])|(?<=[0-9])(?=[A-Za-z!-/:-@])")
_LONG_WHITE = re.compile(f"[{_WHITE}]{{2000,}}")
CHUNK_CHARS = 16_384
BATCH_CHARS = 4_000_000


def safe_chunks(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """Parts of the text, cut at the first safe boundary at or after each limit."""
    start = 0
    while len(text) - start > limit:
        m = _CUT.search(text, start + limit)
        if not m or m.start() >= len(text):
            break
        yield text[start : m.start()]
        start = m.start()
    if start < len(text):
        yield text[start:]


class Codec:
    """Encodes texts to the bytes of little-endian unsigned 32-bit ids, and back."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token

    def _ordinary(self, part: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(part), "<u4").tobytes()

    def _one_match(self, part: str) -> bytes:
        return np.array(self.encoding._core_bpe.encode_single_piece(part.encode()), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if len(text) < 2000:
            return self._ordinary(text)
        out, start = [], 0
        for m in _LONG_WHITE.finditer(text):
            # before a non-space, a run's last character is no part of the run's match
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self._ordinary(x) for x in safe_chunks(text[start : m.start()])]
            out.append(self._one_match(text[m.start() : end]))
            start = end
        out += [self._ordinary(x) for x in safe_chunks(text[start:])]
        return b"".join(out)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(rank_file: str | None = None, pattern: str | None = None) -> Codec:
    """The process's codec; without a path, of the installed public vocabulary."""
    import public_tokenizers

    return Codec(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def map_texts(docs: DataFrame, row: Callable[[Codec, object, bytes], Iterable[tuple]], schema: str, rank_file: str | None = None, encode: Callable[[Codec, list[str]], list[bytes]] = Codec.encode_batch) -> DataFrame:
    """The rows that row(codec, doc_id, ids) yields for each document, by Arrow batches. In schema, `id` is doc_id's type."""
    schema = schema.replace("doc_id id", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file)
        for batch in batches:
            at, n = 0, batch.num_rows
            chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            while at < n:
                end = at + max(1, int(np.searchsorted(np.cumsum(chars[at:]), BATCH_CHARS)))
                ids, texts = batch.column(0)[at:end].to_pylist(), [t or "" for t in batch.column(1)[at:end].to_pylist()]
                rows = [r for i, x in zip(ids, encode(own, texts), strict=True) for r in row(own, i, x)]
                columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                at = end

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode_documents(docs: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, ids: each text's ids as an array."""
    return map_texts(docs, lambda _, i, ids: [(i, np.frombuffer(ids, "<u4").tolist())], "doc_id id, ids array<int>", rank_file)


def decode_documents(encoded: DataFrame, rank_file: str | None = None) -> DataFrame:
    """doc_id, bytes: the raw bytes of each row's ids; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file)
        for batch in batches:
            raw = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def _digests(own: Codec, doc_id: object, ids: bytes) -> list[tuple]:
    return [(doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest())]


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_texts(documents(spark, sf_dir), _digests, "doc_id id, n_tokens long, ids_sha256 string, decoded_sha256 string")
