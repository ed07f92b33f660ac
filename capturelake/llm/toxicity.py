"""Toxic passages by maximum-scoring segments of token log-odds.

A word's log-odds of being toxic is a Dirichlet-smoothed count ratio whose prior is that of the word's six-, five- and
four-letter beginnings in turn, and at last the corpus. With a drift taken off each token, a linear scan finds every
maximal segment of a text (no segment is part of a better one). Segment scores S become bits lambda S - ln(K n) by the
extreme-value law of the best segment in n clean tokens; a document's score is a logistic function of its best segment
and of the sum over its significant segments.

Counts and calibration use at most `max_per_class` labelled documents of each label, taken in hash order, never the
held-out fold crc32(doc_id) mod 5 = 0. A doc_id labelled more than once is toxic if any label says so; null labels are
left out. Every unit of two or more of these toxic documents is kept, whatever their number. Null and empty texts have no segments and get the score of a text without toxic tokens.
"""

from __future__ import annotations

import collections
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import base_columns, cut_lineage, worker_memory

MAX_PER_CLASS = 5_000
BEGINNINGS = (4, 5, 6)
STRENGTH = 4.0
DRIFT = 1.2
WORDS_KEPT = 40_000
#: A word met again after more tokens than this counts as new.
STRETCH = 500
_WORD = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def units(word: str) -> list[str]:
    """The word's beginnings, marked, then the word itself."""
    return [f"{word[:k]}*" for k in BEGINNINGS if len(word) > k] + [word]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order, in linear time.

    A candidate keeps the place of the nearest one before it whose sum before is smaller; a search follows these links, so
    every candidate is passed over once.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, link
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            start, before, through, j = i, total, total + s, len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            while j >= 0 and found[j][3] < through:  # what ends lower is part of this one
                start, _, before, _, link = found[j]
                del found[j:]
                j = link
            found.append((start, i + 1, before, through, j))
        total += s
    return [(a, b, right - left) for a, b, left, right, _ in found]


@dataclass
class Model:
    counts: dict[str, tuple[int, int]]
    base: float
    rest: float
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict)

    def word_score(self, word: str) -> float:
        p, seen = self.base, False
        for u in units(word):
            if u in self.counts:
                t, c = self.counts[u]
                p, seen = (t + STRENGTH * p) / (t + c + STRENGTH), True
        return (math.log(p / (1 - p)) - math.log(self.base / (1 - self.base)) if seen else self.rest) - DRIFT

    def scores(self, words: list[str]) -> list[float]:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        times: dict[str, tuple[int, int]] = {}
        out = []
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = self.word_score(w)
            if s > 0:  # in a stretch of text the k-th time counts 1/k, so that repetition alone makes no passage
                k, at = times.get(w, (0, i))
                k = k + 1 if i - at <= STRETCH else 1
                times[w] = k, i
                s /= k
            out.append(s)
        return out

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        s = self.scores(words)
        return len(words), (maximal_segments(s) if s and max(s) > 0 else [])

    def bits(self, n: int, score: float) -> float:
        return self.rate * score - self.log_k - math.log(max(n, 1))

    def features(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        b = [self.bits(n, s) for _, _, s in segments]
        return (max(b, default=-12.0), math.log1p(sum(x for x in b if x > 0)))

    def probability(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        best, total = self.features(n, segments)
        z = self.weights[0] + self.weights[1] * best + self.weights[2] * total
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic of at most `most` documents of either label."""
    marked = base_columns(labels, {"doc_id": "long", "toxic": "int"}).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where("crc32(cast(doc_id as string)) % 5 <> 0")
    picked = [marked.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    return docs.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # 2 * most ids


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """docs: doc_id, text. Without usable labels every text gets the score 0.5 * base rate."""
    rows = cut_lineage(_training_rows(docs, labels, max_per_class).select("text", "toxic"))

    def count(batches):
        with worker_memory("toxicity"):
            seen: dict[str, list[int]] = collections.defaultdict(lambda: [0, 0])
            for batch in batches:
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    for u in {u for w in set(tokens(text or "")) for u in units(w)}:
                        seen[u][0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["unit", "t", "c"])

    counted = rows.mapInArrow(count, "unit string, t long, c long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    whole = counted.where("not endswith(unit, '*')")
    sums = whole.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum(F.expr("if(t < 2, t, 0)")).alias("rt"), F.sum(F.expr("if(t < 2, c, 0)")).alias("rc")).first()
    if not sums.t or not sums.c:
        return Model({}, 0.5, -DRIFT)
    kept = counted.where("t >= 2").toArrow()  # units of at most max_per_class toxic texts; as rows they would take many times the memory
    pairs: dict[tuple[int, int], tuple[int, int]] = {}  # equal counts are one object, here and in the tasks
    rest = math.log(((sums.rt or 0) + 1) / (sums.t + 1)) - math.log(((sums.rc or 0) + 1) / (sums.c + 1))
    told = (zip(*(column.to_pylist() for column in batch.columns), strict=True) for batch in kept.select(["unit", "t", "c"]).to_batches(max_chunksize=10_000))
    model = Model({u: pairs.setdefault((t, c), (t, c)) for rows_ in told for u, t, c in rows_}, sums.t / (sums.t + sums.c), min(rest, 0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(m: Model, text: str | None) -> tuple[list[float], list[tuple[int, int, float]]]:
        scores = m.scores(tokens(text or ""))
        return scores, (maximal_segments(scores) if scores and max(scores) > 0 else [])

    def scan(batches):
        for batch in batches:
            cells: collections.Counter = collections.Counter()
            best, sizes = [], []
            for text in batch.column("text").to_pylist():
                scores, segments = found(shared.value, text)
                cells.update(np.round(np.array(scores) * 4).astype(int).tolist())
                best.append(max((x for _, _, x in segments), default=None))
                sizes.append(len(scores))
            none = pa.nulls(len(cells), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([none, none.cast(pa.float64()), pa.array(list(cells), pa.int32()), pa.array(list(cells.values()), pa.int64())], names)

    names = ["n", "best", "cell", "times"]
    clean = cut_lineage(rows.where("toxic = 0").select("text").mapInArrow(scan, "n long, best double, cell int, times long"))
    cells = {r.cell / 4: r.times for r in clean.where("cell is not null").groupBy("cell").agg(F.sum("times").alias("times")).collect()}  # a row for each quarter of a score
    value, weight = np.array(list(cells), float), np.array(list(cells.values()), float)
    low, high = 1e-3, 20.0
    if len(value) and value.max() > 0:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.average(np.exp(np.clip(mid * value, None, 50)), weights=weight) < 1 else (low, mid)
    model.rate = min(low, 5.0)
    tails = [model.rate * r.best - math.log(r.n) for r in clean.where("best is not null").select("n", "best").collect()]  # at most max_per_class rows
    model.log_k = float(np.median(tails)) - 0.3665 if tails else 0.0
    rate, log_k = model.rate, model.log_k

    def measure(batches):
        m = shared.value
        fitted = Model(m.counts, m.base, m.rest, rate, log_k, known=m.known)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                scores, segments = found(fitted, text)
                out.append(fitted.features(len(scores), segments))
            columns = list(zip(*out, strict=True)) or [()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c, pa.float64()) for c in columns)], ["toxic", "best", "total"])

    seen = rows.mapInArrow(measure, "toxic int, best double, total double").collect()  # at most 2 * max_per_class rows
    shared.destroy()  # what it served is checkpointed or here
    x = np.array([(1.0, r.best, r.total) for r in seen])
    y = np.array([r.toxic for r in seen], float)
    w, center, scale = np.zeros(3), np.array([0, *x[:, 1:].mean(0)]), np.array([1, *(x[:, 1:].std(0) + 1e-9)])
    z = (x - center) / scale
    even = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (even * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(3)
        w = w - np.linalg.solve(hess, z.T @ (even * (p - y)) + 0.05 * w)
    coef = w / scale
    coef[0] = w[0] - (w[1:] / scale[1:] * center[1:]).sum()
    model.weights = tuple(map(float, coef))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages as token ranges with their bits."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.counts, model.base, model.rest, model.rate, model.log_k, model.weights))

    def run(batches):
        m = shared.value
        for batch in batches:
            value, found = [], []
            for text in batch.column("text").to_pylist():
                n, segments = m.passages(text or "")
                value.append(m.probability(n, segments))
                found.append([{"start": a, "end": b, "bits": bits} for a, b, s in segments if (bits := m.bits(n, s)) > 0])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value, pa.float64()), pa.array([int(v >= 0.5) for v in value], pa.int32()), pa.array(found, kind)], ["doc_id", "score", "predicted", "passages"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start: int, end: int, bits: double>>")
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"), "score", "predicted", "passages")


def toxicity(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    docs = base_columns(documents, {"doc_id": "long", "text": "string"})
    return score(docs, train(docs, labels, max_per_class)).drop("passages")


def drop_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, columns unchanged, whose score is below 0.5; the decision is taken row by row."""
    docs = base_columns(documents, {"doc_id": "long", "text": "string"})
    shared = documents.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        with worker_memory("toxicity"):
            for batch in batches:
                good = [shared.value.probability(*shared.value.passages(t or "")) < 0.5 for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(good, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
