"""Token counts without ids: each distinct pre-token is cut into pieces once, and documents sum the counts of theirs.

A pass over the texts splits them as the tokenizer's pre-tokenizer does and keeps, for each block of neighbouring rows,
each row's (place, frequency) pairs and the block's dictionary of distinct pre-tokens, split by a hash into sheets. A sheet
goes to the task of its hash, where every pre-token is cut once by the library's model, and comes back to its block as
counts in the sheet's order. So what moves is one packed sheet for each block and hash and each block's packed pairs: a
pre-token that every document holds moves once for each block.

Defined results: a null or empty text has 0 bytes and 0 tokens; every input row gives one row, repeated and null ids
included; other columns are ignored. A text longer than a block is a block of its own and is split in slices.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from capturelake.llm.bpe import byte_characters
from capturelake.llm.common import base_columns, shuffle_width, utf8_buffers, written

#: Code points of a block's texts; results don't depend on it.
BLOCK_CHARS = 4_000_000
#: Matches taken at once from a text longer than a block.
SLICE = 500_000
#: Fixed value: the split of byte-level pre-tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def recent_characters() -> str:
    """A character class of the code points that Unicode 3.2 had not assigned: on these two libraries' tables may differ."""
    ranges: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


class PreTokens:
    """Splits texts as the tokenizer file does and counts the pieces of one pre-token."""

    def __init__(self, path: str) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as lines:
            layout = json.load(lines)
        pre = layout.get("pre_tokenizer") or {}
        if layout.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or layout["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normalizer and prefix space is counted by pre-tokens")
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError(f"{path}: added tokens that take white space or whole words are not supported")
        marks = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, marks))) if marks else None
        self.pattern = regex.compile(SPLIT)
        self.recent = re.compile(recent_characters())
        self.spelling = byte_characters()

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and how many of these it has."""
        if self.added is None:
            return [text], 0
        parts = self.added.split(text)
        return [p for p in parts if p], len(parts) - 1

    def split(self, segment: str):
        """The pre-tokens of a segment; the library itself splits one with characters on which tables may differ."""
        if segment.isascii() or not self.recent.search(segment):
            if len(segment) <= BLOCK_CHARS:
                return self.pattern.findall(segment)
            return (m.group() for m in self.pattern.finditer(segment))
        return (segment[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment))

    def frequencies(self, text: str) -> tuple[Counter, int]:
        segments, added = self.segments(text)
        out: Counter = Counter()
        for segment in segments:
            pieces = self.split(segment)
            if isinstance(pieces, list):
                out.update(pieces)
            else:
                while part := list(islice(pieces, SLICE)):
                    out.update(part)
        return out, added

    def pieces(self, pre_token: str) -> int:
        """How many pieces the library's model cuts it into."""
        return len(self.tokenizer.model.tokenize("".join(map(self.spelling.__getitem__, pre_token.encode()))))


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def _packed(values) -> bytes:
    return zlib.compress(np.asarray(values, np.int32).tobytes(), 1)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int32)


class _Block:
    """Rows of texts under way: their pairs by running piece numbers, which are put in the order of sheets at the end."""

    def __init__(self, sheets: int) -> None:
        self.sheets, self.known = sheets, {}
        self.keys, self.sizes, self.added, self.width, self.places, self.times = [], [], [], [], [], []

    def add(self, key, size: int, counts: Counter, added: int) -> None:
        self.keys.append(key)
        self.sizes.append(size)
        self.added.append(added)
        self.width.append(len(counts))
        known = self.known
        self.places += [known.setdefault(p, len(known)) for p in counts]
        self.times += counts.values()

    def records(self, block: int) -> pa.RecordBatch:
        """One row of pairs (sheet -1) and one for each sheet that is not empty."""
        raw = [p.encode() for p in self.known]
        sheet = np.fromiter((zlib.crc32(r) % self.sheets for r in raw), np.int64, len(raw))
        order = np.lexsort((np.arange(len(raw)), sheet))
        place = np.empty(len(raw), np.int64)
        place[order] = np.arange(len(raw))
        row = np.repeat(np.arange(len(self.width)), self.width)
        at, times = place[np.asarray(self.places, np.int64)], np.asarray(self.times, np.int32)
        inside = np.lexsort((at, row))
        at = at[inside]
        steps = np.diff(at, prepend=0)
        starts = np.cumsum([0, *self.width])[:-1]
        starts = starts[np.asarray(self.width, np.int64) > 0]
        steps[starts] = at[starts]
        used, first = np.unique(sheet[order], return_index=True)
        pieces = [[raw[i] for i in part] for part in np.split(order, first[1:])] if len(raw) else []
        n, none = len(pieces), [None] * len(pieces)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n + 1)), pa.array([-1, *used.tolist()], pa.int32()), pa.array([self.keys, *none], pa.list_(pa.int64())), pa.array([self.sizes, *none], pa.list_(pa.int64())), pa.array([self.added, *none], pa.list_(pa.int64())),
                pa.array([_packed(self.width), *[_packed([len(p) for p in part]) for part in pieces]], pa.binary()), pa.array([_packed(steps), *[zlib.compress(b"".join(part), 1) for part in pieces]], pa.binary()), pa.array([_packed(times[inside]), *none], pa.binary()),
            ],
            ["block", "sheet", "keys", "n_bytes", "added", "width", "content", "times"],
        )


def frequency_blocks(docs: DataFrame, vocabulary: str, sheets: int) -> DataFrame:
    """Blocks of (doc_id, text) rows. Sheet -1 holds by row keys, n_bytes, added (tokens of the vocabulary's added strings)
    and, packed, `width`, the number of its distinct pre-tokens, with their places as steps (`content`) and `times`; the
    others hold the block's pre-tokens of one hash: `width` their bytes, `content` their text.

    Blocks are numbered by task and place in it, so a repeated task writes the same numbers. Nothing is joined here.
    """

    def run(batches):
        splitter, at, task, block, held = pre_tokens(vocabulary), 0, TaskContext.get().partitionId(), _Block(sheets), 0
        for batch in batches:
            _, offsets = utf8_buffers(batch.column("text"))
            for key, size, text in zip(batch.column("doc_id"), np.diff(offsets), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if block.keys and held + len(text) > BLOCK_CHARS:
                    yield block.records(task << 32 | at)
                    at, held, block = at + 1, 0, _Block(sheets)
                block.add(key.as_py(), int(size), *splitter.frequencies(text))
                held += len(text)
        if block.keys:
            yield block.records(task << 32 | at)

    return docs.mapInArrow(run, "block long, sheet int, keys array<long>, n_bytes array<long>, added array<long>, width binary, content binary, times binary")


def sheet_counts(sheets: DataFrame, vocabulary: str) -> DataFrame:
    """(block, sheet, counts): how many pieces each pre-token of a sheet has, each distinct one cut once."""

    def run(batches):
        splitter, known = pre_tokens(vocabulary), {}
        for batch in batches:
            out = []
            for width, content in zip(batch.column("width").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text, ends = zlib.decompress(content), np.cumsum(_numbers(width)).tolist()
                pieces = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                for p in pieces:
                    if p not in known:
                        known[p] = splitter.pieces(p.decode())
                out.append(_packed([known[p] for p in pieces]))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("sheet"), pa.array(out, pa.binary())], ["block", "sheet", "counts"])

    return sheets.mapInArrow(run, "block long, sheet int, counts binary")


def token_counts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Per input row: the key, n_bytes of UTF-8, n_tokens by the byte-level BPE file, and whether these are over `limit`.

    The block table is written once in the shared checkpoint folder. There are as many sheets as shuffle partitions, so
    what a task knows of pre-tokens is its part of the corpus's distinct ones.
    """
    if df.schema[key].dataType not in (T.LongType(), T.IntegerType(), T.ShortType()):
        raise ValueError("the key must be integral")
    n = shuffle_width(df.sparkSession)
    docs = base_columns(df, {key: "long", text: "string"}).toDF("doc_id", "text")
    blocks = written(frequency_blocks(docs, vocabulary, n))
    sheets = blocks.where("sheet >= 0").select("block", "sheet", "width", "content").repartition(n, "sheet")
    counts = sheet_counts(sheets, vocabulary).withColumnRenamed("block", "of")

    def total(parts: pa.Table, rows: pa.Table) -> pa.Table:
        parts = sorted(zip(parts.column("sheet").to_pylist(), parts.column("counts").to_pylist(), strict=True))
        pieces = np.concatenate([np.zeros(0, np.int32), *[_numbers(c) for _, c in parts]]).astype(np.int64)
        row = {name: rows.column(name)[0].as_py() for name in rows.column_names}
        width, steps, times = (_numbers(row[name]) for name in ("width", "content", "times"))
        ends = np.cumsum(width, dtype=np.int64)
        run_up = np.cumsum(steps, dtype=np.int64)
        before = np.concatenate([[0], run_up])[ends - width]  # of the rows above: steps begin anew in each row
        sums = np.concatenate([[0], np.cumsum(pieces[run_up - np.repeat(before, width)] * times, dtype=np.int64)])
        n_tokens = np.asarray(row["added"], np.int64) + sums[ends] - sums[ends - width]
        return pa.table({"doc_id": pa.array(row["keys"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": n_tokens, "over_limit": n_tokens > limit})

    pairs = blocks.where("sheet = -1").select("block", "keys", "n_bytes", "added", "width", "content", "times")
    counted = counts.groupBy("of").cogroup(pairs.groupBy("block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("doc_id", key)
