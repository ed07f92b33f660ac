"""Operators on inputs where a bound or a fixed choice would lose part of the answer."""

import collections
import random
import zlib

import corpus_pipeline

from capturelake.llm import toxicity
from tests.llm.test_exact import brute_components


def test_pipeline_drops_copies_of_five_word_jaccard_from_080(spark):
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k, change in enumerate(["scattered", "appended", "changed", "too far"]):
        base = new(200)
        copy = list(base)
        if change == "scattered":  # 176 of 216 five-word sets shared, 181 of 213 four-word ones
            for i in (30, 70, 110, 150):
                copy[i : i + 1] = new(1)
        if change == "changed":
            copy[50:65] = new(15)
        copy += new({"appended": 45, "too far": 52}.get(change, 0))
        rows += [(2 * k + 1, " ".join(base)), (2 * k + 2, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, None).collect())
    assert got == sorted(i for i, _, c in brute_components(rows, 5, 80) if i == c) == [1, 3, 5, 7, 8]


def test_toxicity_keeps_every_unit_of_two_toxic_documents(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:8]
    texts = [" ".join(f"{k % 4:x}{w:05x}z" for w in range(9_000)) for k in range(8)]  # each word in two documents, all of them toxic
    texts = [f"{t} {' '.join(f'{w:04d}' for w in range(50))}" for t in texts]
    clean = [i for i in range(100, 140) if zlib.crc32(str(i).encode()) % 5][:8]
    rows = list(zip(ids, texts, strict=True)) + [(i, f"{' '.join(f'{w:04d}' for w in range(50))} plain words {i}") for i in clean]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in ids] + [(i, 0) for i in clean], "doc_id long, toxic int")
    want = collections.defaultdict(lambda: [0, 0])
    for i, text in rows:
        for u in {u for w in set(toxicity.tokens(text)) for u in toxicity.units(w)}:
            want[u][i in clean] += 1
    want = {u: tuple(n) for u, n in want.items() if n[0] >= 2}
    assert len(want) > 70_000
    assert toxicity.train(docs, labels).counts == want
