"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives token bytes and ranks. Each match of the split pattern is merged on its own; a batch's distinct
matches go to the library once, so the cost of merging follows the vocabulary of the corpus rather than its length.
Nulls count as empty text: no tokens, empty bytes. The vocabulary file is read where the task runs and never copied.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from capturelake.llm.common import base_columns, worker_memory

#: Matches kept with their ids in one Python worker; the table starts anew beyond that, results don't change.
PIECES_KEPT = 150_000
#: Matches that the library encodes at a time: its encodings take far more memory than the ids.
ENCODED = 2_000


def byte_characters() -> dict[int, str]:
    """The usual reversible table from bytes to printable characters: printable Latin-1 stays, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(plain)))
    return table


class Codec:
    """Encodes and decodes text by one rank file."""

    def __init__(self, rank_path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        chars = byte_characters()
        spell = lambda raw: "".join(map(chars.__getitem__, raw))
        merges = []
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            pairs = [(ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
            merges += [(spell(token[:i]), spell(token[i:])) for _, _, i in sorted(pairs)]
        self.tokenizer = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in chars.items()}
        size = max(ranks.values()) + 1
        self.token_bytes = [b""] * size
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = bytes(map(back.__getitem__, token))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.written: dict[str, str] = {}

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, rows: list[list[str]]) -> None:
        """Puts the ids of every match into the table."""
        new = list({p for row in rows for p in row if p not in self.known})
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known, self.written = {}, {}
            new = list({p for row in rows for p in row})
        for at in range(0, len(new), ENCODED):
            part = new[at : at + ENCODED]
            for piece, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[piece] = ids = tuple(coded.ids)
                self.written[piece] = ",".join(map(str, ids))

    def ids(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            out += known[p]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids of this vocabulary."""
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_any(self, ids: list[int | None]) -> bytes:
        """The bytes of any ids; one outside the vocabulary, or null, stands for the replacement character U+FFFD."""
        known = self.token_bytes
        return b"".join(known[i] if i is not None and 0 <= i < len(known) else b"\xef\xbf\xbd" for i in ids)

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Code point range of each token; tokens that share a split character all cover it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        leads = (raw & 0xC0) != 0x80
        index = np.cumsum(leads) - 1
        ends = np.cumsum([len(self.token_bytes[i]) for i in ids])
        return [(int(index[e - len(self.token_bytes[i])]), int(index[e - 1]) + 1) for i, e in zip(ids, ends, strict=True)]


@lru_cache(maxsize=2)
def codec(rank_path: str, pattern: str) -> Codec:
    return Codec(rank_path, pattern)


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def _row_groups(texts: list[str], most: int = 4_000_000):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key, token ids, and each token's code point range in the text."""

    def run(batches):
        c = codec(rank_path, pattern)
        for batch in batches:
            texts = _texts(batch, text)
            for a, b in _row_groups(texts):
                rows = [c.pieces(t) for t in texts[a:b]]
                c.learn(rows)
                ids = [c.ids(r) for r in rows]
                spans = [c.offsets(t, i) for t, i in zip(texts[a:b], ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(a, b - a), pa.array(ids, pa.list_(pa.int32())), pa.array([[x for x, _ in s] for s in spans], pa.list_(pa.int32())), pa.array([[y for _, y in s] for s in spans], pa.list_(pa.int32()))],
                    ["id", "ids", "starts", "ends"],
                )

    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("ids", kind), T.StructField("starts", kind), T.StructField("ends", kind)])
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("id", key)


def decode(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per input row: the key and the UTF-8 bytes that the ids stand for (binary: ids may end inside a character); see `Codec.decode_any` for other ids."""

    def run(batches):
        c = codec(rank_path, pattern)
        for batch in batches:
            raw = [c.decode_any(i or []) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(raw, pa.binary())], ["id", "bytes"])

    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("bytes", T.BinaryType())])
    return df.select(key, ids).mapInArrow(run, schema).withColumnRenamed("id", key)


def token_digests(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, SHA-256 of the comma-joined ids and of the decoded bytes. Repeated rows stay repeated."""

    def run(batches):
        with worker_memory("byte_bpe", codec.cache_clear):
            c = codec(rank_path, pattern)
            for batch in batches:
                texts = _texts(batch, "text")
                for a, b in _row_groups(texts):
                    rows = [c.pieces(t) for t in texts[a:b]]
                    c.learn(rows)
                    n, coded, decoded = [], [], []
                    for row in rows:
                        ids = c.ids(row)
                        n.append(len(ids))
                        coded.append(hashlib.sha256(",".join(map(c.written.__getitem__, row)).encode()).hexdigest())
                        decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = base_columns(df, {"doc_id": "long", "text": "string"})
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
