"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles (a shorter text is one shingle), weighted by how often they occur. For each of `samples`
draws a term gets r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), fixed by the term and the draw; with weight w,
t = floor(ln w / r + b), y = exp(r (t - b)), a = c / (y exp(r)), and the term with the smallest a is the sample (term, t).
Two texts agree in a draw with the probability of their generalised Jaccard similarity, sum(min w) / sum(max w).
The random variables come from one fixed table that a term walks with its own start and stride; equal values fall to the
smaller term hash. A fingerprint holds 16 bits of each sample as hexadecimal digits.

Null text counts as empty; an empty text's fingerprint is the empty string, which is like another empty one only.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import base_columns, mix64, row_blocks, shingles, shuffle_width, utf8_buffers, words

SHINGLE = 5
SAMPLES = 64
_TABLE_BITS = 17
_CHUNK = 4096
_FIRST = -(2**63)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    n = 1 << _TABLE_BITS
    r, c, b = rng.gamma(2.0, size=n), rng.gamma(2.0, size=n), rng.random(n)
    return r, np.log(c), b, (np.log(c) + r * b - r).astype(np.float32)


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """16-bit samples of distinct terms (64-bit hashes in ascending order) with positive weights."""
    r, ln_c, b, unit = _tables()
    lo, step = terms.astype(np.uint32), (terms >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    draws = np.arange(samples, dtype=np.uint32)[:, None]
    best = np.full(samples, np.inf, np.float32)
    term, turn = np.zeros(samples, np.uint64), np.zeros(samples, np.uint64)
    rows = np.arange(samples)
    for at in range(0, len(terms), _CHUNK):
        s = slice(at, at + _CHUNK)
        place = (lo[None, s] + draws * step[None, s]) >> np.uint32(32 - _TABLE_BITS)
        value = unit[place]
        heavy = np.flatnonzero(weights[s] != 1)
        t = None
        if len(heavy):
            p = place[:, heavy]
            t = np.floor(np.log(weights[s][heavy])[None, :] / r[p] + b[p])
            value[:, heavy] = ln_c[p] - r[p] * (t - b[p]) - r[p]
        pick = value.argmin(axis=1)
        low = value[rows, pick]
        better = low < best
        best[better], term[better] = low[better], terms[s][pick[better]]
        turns = np.zeros(samples, np.int64)
        if t is not None:
            slot = np.searchsorted(heavy, pick)
            slot[slot == len(heavy)] = 0
            hit = heavy[slot] == pick
            turns[hit] = t[rows[hit], slot[hit]]
        turn[better] = turns[better].astype(np.uint64)
    return (mix64(term + turn * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def _signatures(texts: list[str], samples: int) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    column = pa.array(texts, pa.large_string())
    flat, offsets = utf8_buffers(column)
    for a, b in row_blocks(offsets):
        h, _, first = words(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            grams = shingles(h, first, i, SHINGLE)
            out.append(signature(*np.unique(grams, return_counts=True), samples) if len(grams) else None)
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def _hex(s: np.ndarray | None) -> str:
    return "" if s is None else s.astype(">u2").tobytes().hex()


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: the key and the fingerprint of its whole text."""

    def run(batches):
        for batch in batches:
            sigs = _signatures([t or "" for t in batch.column(text).to_pylist()], samples)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([_hex(s) for s in sigs], pa.string())], ["id", "fingerprint"])

    return df.select(key, text).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", key)


def _in_order(df: DataFrame) -> DataFrame:
    """Rows dealt to ranges of doc_id, each range followed by the next range's first row, all sorted: (part, tail, doc_id, text)."""
    parts = max(2, shuffle_width(df.sparkSession))
    key = F.coalesce("doc_id", F.lit(_FIRST))
    cuts = df.select(F.min(key), F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()
    if cuts[0] is None:
        return df.select(F.lit(0).alias("part"), F.lit(False).alias("tail"), "doc_id", "text")
    bounds = np.unique(np.array([cuts[0], *cuts[1]], np.int64))

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_FIRST).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(ids), bool)), batch.column("doc_id"), batch.column("text")], ["part", "tail", "doc_id", "text"])
            lead = np.flatnonzero(bounds[part] == ids)
            if len(lead):
                rows = batch.take(pa.array(lead))
                yield pa.RecordBatch.from_arrays([pa.array((part[lead] - 1) % len(bounds), pa.int32()), pa.array(np.ones(len(lead), bool)), rows.column("doc_id"), rows.column("text")], ["part", "tail", "doc_id", "text"])

    dealt = df.mapInArrow(deal, "part int, tail boolean, doc_id long, text string")
    return dealt.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("part", "tail", "doc_id", "text")


def edit_comparison(df: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is replaced by the start of the next document.

    Order is ascending doc_id (null first), then text; the last document is followed by the first. One document alone is
    followed by itself. Ranges of doc_id are processed apart, so no task sees more than its range and one row.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, signature, next text, next signature)."""
        cut = [len(r[1]) - len(r[1]) // 4 for r in rows]
        edited = [r[1][:c] + r[3][: len(r[1]) - c] for r, c in zip(rows, cut, strict=True)]
        sigs = _signatures(edited, samples)
        out = [
            (r[0], len(r[1]), hashlib.sha256(e.encode()).hexdigest(), _hex(r[2]), _hex(s), likeness(r[2], s), likeness(r[2], r[4]))
            for r, e, s in zip(rows, edited, sigs, strict=True)
        ]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        held = None  # the last row, whose successor is still to come
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = [t or "" for t in some.column("text").to_pylist()]
                sigs, done = _signatures(texts, samples), []
                for part, tail, doc, text, sig in zip(some.column("part").to_pylist(), some.column("tail").to_pylist(), some.column("doc_id").to_pylist(), texts, sigs, strict=True):
                    if held is not None and held[0] == part:
                        done.append((*held[1:], text, sig))
                        held = None
                    if not tail:
                        held = (part, doc, text, sig)
                if done:
                    yield finish(done)
        if held is not None:  # only without any tail row
            yield finish([(*held[1:], held[2], held[3])])

    docs = base_columns(df, {"doc_id": "long", "text": "string"})
    return _in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
