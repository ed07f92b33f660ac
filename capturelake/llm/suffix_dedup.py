"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

Every 200-byte window has one anchor: its smallest 32-byte hash, leftmost on ties. Equal windows have equal anchors at
equal offsets, so windows meet by their anchor's hash and nothing else need be compared. Consecutive windows with one
anchor form a record, at most 368 bytes of text. Records of equal bytes are one content:

1. all records without their bytes: anchors met once fall away, contents met twice are repeats as a whole (anchors met
   twice in one block of rows are known at once and only a witness of each meets the others);
2. where an anchor has several contents, their bytes are indexed: contents arrive in batches, each batch gets a suffix
   array over the anchored suffixes (ordered by anchor, then the bytes that follow), is merge-scanned against every
   existing level for windows that agree to the left and right, and levels of equal rank merge into the next one;
3. matches go back to all occurrences, and each document drops the bytes that matches cover.

An anchor with more than `hot` contents is compared by counting its windows' hashes with map-side combining instead, so
no group of any size meets in one task. Windows are compared by 64-bit hashes of their left part and real bytes of
their right part. Null text counts as empty; a text over 256 MB is an error, never cut; equal rows are repeats of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import base_columns, mix64, row_blocks, span_hashes, utf8_buffers, written

GRAM = 32
_POSITION = np.uint64(2**28 - 1)
_CODE = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
BATCHES = 4
GROUP_ROWS = 20_000
HOT = 50_000


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    h, step = _CODE[data], _MUL
    for width in (1, 2, 4, 8, 16):
        h = h[:-width] * step + h[width:]
        step = step * step
    return mix64(h)


def records(data: np.ndarray, offsets: np.ndarray, window: int):
    """Of a block of rows: row, anchor hash, first window, last window, anchor position (block byte offsets)."""
    none = np.zeros(0, np.int64)
    if len(data) > 2**28:
        raise ValueError("a text is longer than 256 MB: split it first, its positions have 28 bits")
    if len(data) < window or not (np.diff(offsets) >= window).any():
        return none, none.astype(np.uint64), none, none, none
    with np.errstate(over="ignore"):
        h = _gram_hashes(data)
    low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span, width = 1, window - GRAM + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & _POSITION).astype(np.int64)
    good = np.ones(len(anchor), bool)
    for end in offsets[1:-1]:
        good[max(end - window + 1, 0) : end] = False
    new = good.copy()
    new[1:] &= ~(good[:-1] & (anchor[1:] == anchor[:-1]))
    last = good.copy()
    last[:-1] &= ~(good[1:] & (anchor[1:] == anchor[:-1]))
    first, final = np.flatnonzero(new), np.flatnonzero(last)
    row = np.searchsorted(offsets, first, side="right") - 1
    return row, h[anchor[first]], first, final, anchor[first]


def _contents(data, offsets, window):
    row, anchor, first, final, at = records(data, offsets, window)
    with np.errstate(over="ignore"):
        key = mix64(span_hashes(data, first, final + window) + (at - first).astype(np.uint64) * _MUL) if len(row) else anchor
    return row, anchor, key, first, final, at


class Level:
    """A suffix array over anchored suffixes: sorted, with each entry's left and right bytes and its matched windows."""

    def __init__(self, key: np.ndarray, content: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, hit: np.ndarray) -> None:
        self.parts = (key, content, left, right, low, high, hit)
        self.key, self.content, self.left, self.right, self.low, self.high, self.hit = self.parts

    @classmethod
    def build(cls, anchors: np.ndarray, contents: np.ndarray, texts: list[bytes], at: np.ndarray, windows: np.ndarray, window: int) -> Level:
        """at: bytes before the anchor; windows: how many windows start in the text, offsets at - windows + 1 .. at."""
        n, reach = len(texts), window - GRAM
        right, left = np.zeros((n, window), np.uint8), np.zeros((n, reach + 1), np.uint64)
        behind = np.zeros((n, reach), np.uint8)
        for i, (t, p) in enumerate(zip(texts, at.tolist(), strict=True)):
            b = np.frombuffer(t, np.uint8)
            r = b[p : p + window]
            right[i, : len(r)] = r
            behind[i, :p] = b[:p][::-1]
        with np.errstate(over="ignore"):
            for d in range(reach):
                left[:, d + 1] = (left[:, d] + _CODE[behind[:, d]]) * _MUL
        key = np.zeros((n, 8 + window), np.uint8)
        key[:, :8] = anchors.astype(">u8").view(np.uint8).reshape(n, 8)
        key[:, 8:] = right
        return cls(key, contents, left, right, at - windows + 1, at, np.zeros((n, reach + 1), bool)).ordered()

    def ordered(self) -> Level:
        order = np.argsort(np.ascontiguousarray(self.key).view(f"S{self.key.shape[1]}").ravel(), kind="stable")
        return Level(*(p[order] for p in self.parts))

    def merge(self, other: Level) -> Level:
        return Level(*(np.concatenate(x) for x in zip(self.parts, other.parts, strict=True))).ordered()

    def scan(self, window: int) -> None:
        """Marks every window offset at which an entry agrees with another one."""
        n = len(self.key)
        if n < 2:
            return
        differ = self.key[1:] != self.key[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), self.key.shape[1]) - 8
        with np.errstate(over="ignore"):
            for d in range(window - GRAM + 1):
                rows = np.flatnonzero((self.low <= d) & (d <= self.high))
                if len(rows) < 2:
                    continue
                run = np.zeros(n, np.uint64)
                run[1:] = np.cumsum(common < window - d)
                k = mix64(run[rows] * _MUL + self.left[rows, d])
                order = np.argsort(k, kind="stable")
                same = k[order][1:] == k[order][:-1]
                self.hit[rows[order[1:][same]], d] = True
                self.hit[rows[order[:-1][same]], d] = True


class LogIndex:
    """Levels of ranks that double: a new batch is scanned against each level, then levels of equal rank merge."""

    def __init__(self, window: int) -> None:
        self.window, self.levels = window, {}

    def add(self, batch: Level) -> None:
        batch.scan(self.window)
        n = len(batch.key)
        for level in self.levels.values():
            both = Level(*(np.concatenate(x) for x in zip(batch.parts, level.parts, strict=True)))
            mark = np.arange(len(both.key))
            order = np.argsort(np.ascontiguousarray(both.key).view(f"S{both.key.shape[1]}").ravel(), kind="stable")
            seen = Level(*(p[order] for p in both.parts))
            seen.scan(self.window)
            back = np.empty_like(mark)
            back[order] = mark
            hit = seen.hit[back]
            batch.hit |= hit[:n]
            level.hit |= hit[n:]
        rank = 0
        while rank in self.levels:
            batch, rank = batch.merge(self.levels.pop(rank)), rank + 1
        self.levels[rank] = batch

    def matches(self):
        """(content, first offset, last offset) of every maximal run of matched windows."""
        for level in self.levels.values():
            padded = np.zeros((len(level.hit), level.hit.shape[1] + 2), np.int8)
            padded[:, 1:-1] = level.hit
            step = np.diff(padded, axis=1)
            row, lo = np.nonzero(step == 1)
            _, hi = np.nonzero(step == -1)
            yield level.content[row], lo, hi - 1


def _blocks(batches):
    for batch in batches:
        flat, offsets = utf8_buffers(batch.column("text"))
        for a, b in row_blocks(offsets):
            yield batch.slice(a, b - a), flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def repeated_spans(docs: DataFrame, window: int = 200, hot: int = HOT) -> DataFrame:
    """(row, start, end): byte ranges covered by windows that start more than once; docs: row long (unique per distinct text and id), doc_id, text."""

    names = ["anchor", "content", "row", "at", "low", "high"]

    def places(batches):
        for batch, data, offsets in _blocks(batches):
            row, anchor, key, first, final, at = _contents(data, offsets, window)
            base = offsets[row]
            ids = batch.column("row").to_numpy()[row]
            # anchors met twice here are repeats already: their rows need not meet, only one witness of each goes on
            _, lead, where, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            known = times[where] > 1
            witness = lead[times > 1]
            pick = np.concatenate([np.arange(len(row)), witness])
            kind = np.concatenate([np.where(known, 2, 0), np.ones(len(witness), int)]).astype(np.int8)
            deal = np.where(kind == 2, (ids[pick] + at[pick]).astype(np.int64), anchor[pick].view(np.int64))
            columns = [deal, kind, anchor.view(np.int64)[pick], key.view(np.int64)[pick], ids[pick], (at - base)[pick], (at - final)[pick].astype(np.int16), (at - first)[pick].astype(np.int16)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["deal", "kind", *names])

    def met_again(batches):
        held, met = None, False  # the last row waits for its successor; met: its predecessor has its anchor
        for batch in batches:
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not both.num_rows:
                continue
            anchor, kind = both.column("anchor").to_numpy(), both.column("kind").to_numpy()
            same = (anchor[1:] == anchor[:-1]) & (kind[1:] < 2) & (kind[:-1] < 2)
            before = np.concatenate([[met], same])
            keep = (kind == 2) | (before | np.concatenate([same, [False]])) & (kind == 0)
            keep[-1] = False
            yield both.filter(pa.array(keep)).select(names)
            held, met = both.slice(both.num_rows - 1), bool(before[-1])
        if held is not None and (held.column("kind")[0].as_py() == 2 or met and held.column("kind")[0].as_py() == 0):
            yield held.select(names)

    schema = "anchor long, content long, row long, at long, low short, high short"
    dealt = docs.mapInArrow(places, "deal long, kind byte, " + schema).repartition("deal")
    found = dealt.sortWithinPartitions(F.col("kind") == 2, "anchor")
    repeated = written(found.mapInArrow(met_again, schema))
    contents = repeated.groupBy("content").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("rep"), F.first("anchor").alias("anchor"), F.first("low").cast("int").alias("lo"), F.first("high").cast("int").alias("hi"))
    contents = written(contents.select("content", "n", "rep.row", "rep.at", "anchor", "lo", "hi"))
    mixed = contents.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    whole = contents.where("n > 1").select("content", "lo", "hi")
    hot_anchors = mixed.where(F.col("k") > hot).select("anchor", F.lit(True).alias("hot"))
    wanted = contents.join(mixed, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "content", "at", "lo", "hi")).alias("wanted"))  # at most as many as the text has records

    def texts(batches):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        names = ["anchor", "content", "at", "windows", "body"]
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                out = []
                part = batch.slice(a, 200)
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    out += [(w["anchor"], w["content"], w["hi"], w["hi"] - w["lo"] + 1, raw[w["at"] - w["hi"] : w["at"] - w["lo"] + window]) for w in wanted]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def match(batches):
        def flush(rows):
            order = np.lexsort((rows[1], rows[0]))
            anchor, content = rows[0][order], rows[1][order]
            new = np.ones(len(order), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
            order = order[new]
            _, where, size = np.unique(rows[0][order], return_inverse=True, return_counts=True)
            order = order[size[where] > 1]
            if not len(order):
                return
            index = LogIndex(window)
            batch = rows[1][order].view(np.uint64) % np.uint64(BATCHES)
            for b in range(BATCHES):
                o = order[batch == b]
                if len(o):
                    index.add(Level.build(rows[0][o].view(np.uint64), rows[1][o], [rows[4][i] for i in o.tolist()], rows[2][o], rows[3][o], window))
            for content, lo, hi in index.matches():
                if len(content):
                    yield pa.RecordBatch.from_arrays([pa.array(content), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["content", "lo", "hi"])

        held: list[list] = [[], [], [], [], []]
        for batch in batches:
            for part, name in zip(held, ("anchor", "content", "at", "windows", "body"), strict=True):
                part += batch.column(name).to_pylist()
            if len(held[0]) >= GROUP_ROWS:  # rows come sorted by anchor: the last anchor's rows wait
                cut = next((i for i in range(len(held[0]) - 1, 0, -1) if held[0][i] != held[0][i - 1]), 0)
                if cut:
                    yield from flush([*(np.array(x[:cut], np.int64) for x in held[:4]), held[4][:cut]])
                    held = [x[cut:] for x in held]
        if held[0]:
            yield from flush([*(np.array(x, np.int64) for x in held[:4]), held[4]])

    body = docs.join(wanted, "row").mapInArrow(texts, "anchor long, content long, at int, windows int, body binary")
    any_hot = bool(hot_anchors.take(1))
    if any_hot:
        body = body.join(hot_anchors, "anchor", "left")
    cold = (body.where("hot is null").drop("hot") if any_hot else body).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(match, "content long, lo int, hi int")
    hits = whole.unionByName(cold)
    at = lambda hits: repeated.join(hits, "content").select("row", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + window).alias("end"))
    if not any_hot:
        return at(hits)

    def window_hashes(batches):
        for batch in batches:
            for anchor, content, at, n, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "at", "windows", "body")), strict=True):
                start = np.arange(n)
                data = np.frombuffer(raw, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(span_hashes(data, start, start + window).view(np.int64)), pa.array((at - start).astype(np.int32)), pa.array(np.full(n, content))], ["anchor", "hash", "offset", "content"])

    each = body.where("hot").drop("hot").mapInArrow(window_hashes, "anchor long, hash long, offset int, content long")
    twice = each.groupBy("anchor", "hash", "offset").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").drop("a", "b")
    warm = each.join(twice, ["anchor", "hash", "offset"]).select("content", F.col("offset").alias("lo"), F.col("offset").alias("hi"))
    return at(hits.unionByName(warm))


def remove_repeats(df: DataFrame, window: int = 200, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes' digest only; see `repeated_spans` for the ranges."""
    docs = base_columns(df, {"doc_id": "long", "text": "string"}).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(docs, window, hot)
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most as many as the text has windows

    def cut(batches):
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode()
                merged: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                size.append(len(raw))
                gone.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                kept.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(lists, "row", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
