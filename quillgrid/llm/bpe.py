"""Byte-level BPE encoding and decoding through a sentencepiece model built from the vocabulary.

The vocabulary's ranks are written out as a sentencepiece BPE model: one piece a token, its bytes mapped to
printable characters, its score the negative rank, with identity normalisation. Pre-tokens go through that model;
ids decode by the inverse mapping. No tokenizer is trained. The vocabulary has a fixed size, so its broadcast has too.

Defined cases: null text is an empty text; an empty text has no ids and the digest of no bytes; repeated rows give
repeated results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgrid.llm.common import small_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHED = 100_000  # segments, and pre-tokens, whose ids a worker remembers

# Unicode's White_Space characters.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return [chr(b) if b in set(printable) else chr(0x100 + others.index(b)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protocol buffer field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised ModelProto whose ids are the ranks; ids that the vocabulary leaves free are unused pieces."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a token: {missing}")
    chars, by_rank = byte_characters(), {r: t for t, r in ranks.items()}
    normal, unknown, unused = 1, 2, 5
    out = []
    for i in range(max(by_rank) + 1):
        piece = "".join(chars[b] for b in by_rank[i]) if i in by_rank else f" unused {i}"
        kind = normal if i in by_rank else unused
        out.append(_field(1, _field(1, piece) + _field(2, float(-i)) + _field(3, kind)))
    out.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)))
    bpe = 2
    out.append(_field(2, _field(3, bpe) + _field(40, len(out) - 1)))  # TrainerSpec: model_type, unk_id
    identity = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    out.append(_field(3, identity))  # NormalizerSpec: no dummy prefix, white space kept and not escaped
    return b"".join(out)


class Codec:
    """Encodes texts to little-endian 32-bit ids and decodes them."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import re

        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.token = {i: t for t, i in ranks.items()}
        self.whole = {t: np.uint32(i).tobytes() for t, i in ranks.items()}
        self.chars = {b: c for b, c in enumerate(byte_characters())}
        self.pre_tokens = regex.compile(pattern).findall
        # No pre-token reaches from a visible character over white space, so ids of such segments can be remembered.
        self.segments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.seen = _Remembered(self._segment)
        self.seen_pre = _Remembered(self._pre_token)

    def _segment(self, segment: str) -> bytes:
        return b"".join(map(self.seen_pre.__getitem__, self.pre_tokens(segment)))

    def _pre_token(self, pre: str) -> bytes:
        raw = pre.encode()
        if raw in self.whole:
            return self.whole[raw]
        ids = self.pieces.encode(raw.decode("latin-1").translate(self.chars))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.seen.__getitem__, self.segments(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Remembered(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        out = self.make(key)
        if len(key) < 64:
            self[key] = out
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(digest: str, model: bytes, ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec a worker process; digest: of the model."""
    key = (digest, pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, ranks, pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes; ``with_ids`` adds the ids and the decoded text."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(path)
    model = sentencepiece_model(ranks)
    shared = spark.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model, ranks))
    schema = RESULT + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value, pattern)
        for batch in batches:
            n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                decoded = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(np.frombuffer(ids, "<u4").astype("i4"))
                    all_text.append(decoded.decode())
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
