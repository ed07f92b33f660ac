"""Operators against brute force on the small tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from capturelake.llm import bpe, components, fingerprints, media, ngram_join, queries, suffix_dedup
from capturelake.llm.common import read
from tests.llm.cases import LONG, edge_documents, empty_documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_repeats(docs, window=200):
    count = collections.Counter()
    raw = [(i, t.encode()) for i, t in docs]
    for _, b in raw:
        count.update(b[s : s + window] for s in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_components(docs, width=4, percent=85):
    sets = []
    for _, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    return sorted(((docs[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(docs))), key=str)


def mutated(seed=5):
    """Groups of near copies around the limit, passages shared by many, and short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=70))
    docs = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([5, 20, 60, 200]))
        for _ in range(rng.choice([1, 2, 6, 15])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w) + (" " + passage if rng.random() < 0.3 else "")))
    return docs


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(mutated(), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, sf_dir, made, hot):
    for df in (made, read(spark, sf_dir, "documents").limit(120)):
        docs = texts_of(df)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted(map(tuple, suffix_dedup.remove_repeats(df, hot=hot).collect()), key=str) == brute_repeats(docs)


def test_suffix_dedup_one_document_and_periods(spark):
    docs = [(1, "ab" * 300), (2, "x" * 199), (3, "y" * 200), (4, "y" * 200), (5, LONG[:3000] + "zz" + LONG[:3000])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df).collect()), key=str) == brute_repeats(docs)


def test_level_family_finds_what_one_array_finds():
    rng = random.Random(3)
    core = bytes(rng.choices(b"abc", k=400))
    n = 60
    texts = [bytes(rng.choices(b"abc", k=100)) + core[:200] + bytes(rng.choices(b"abc", k=68)) for _ in range(n)]
    contents, at = np.arange(n), np.full(n, 120)
    build = lambda i: suffix_dedup.Level.build(np.zeros(len(i), np.uint64), contents[i], [texts[j] for j in i], at[i], np.full(len(i), 121), 200)
    whole, parts = suffix_dedup.LogIndex(200), suffix_dedup.LogIndex(200)
    whole.add(build(np.arange(n)))
    for k in range(6):
        parts.add(build(np.arange(n)[k::6]))
    assert sorted(parts.levels) == [1, 2]
    flat = lambda x: sorted((int(c), int(a), int(b)) for m in x.matches() for c, a, b in zip(*m, strict=True))
    assert flat(whole) == flat(parts) and flat(whole)


def test_ngram_join(spark, sf_dir, made):
    for df in (made, read(spark, sf_dir, "documents")):
        assert sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=str) == brute_components(texts_of(df))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_large_near_group(spark, seed):
    """One base edited now and then, so that most sets link through a hub and many stay just below the limit."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4, 5])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [f"x{rng.randrange(300)}"], [w[at], "again"]])
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for width, percent, hot in ((4, 85, ngram_join.HOT), (5, 80, ngram_join.HOT), (4, 85, 16)):
        assert sorted(map(tuple, ngram_join.ngram_components(df, width, percent, hot).collect()), key=str) == brute_components(docs, width, percent)


def test_ngram_join_without_doc_id(spark):
    """A text without a doc_id still links two others; a component without any doc_id has none."""
    w = [f"w{i}" for i in range(60)]
    far = w[:57] + ["a", "b", "c"] + w[57:]
    docs = [(7, " ".join(w[4:])), (None, " ".join(w)), (3, " ".join(far)), (None, "alone here in the world now"), (None, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    linked = brute_components([(i if i is not None else 100 + k, t or "") for k, (i, t) in enumerate(docs)])
    assert sorted((c if c < 100 else None for _, _, c in linked), key=str) == sorted(got.values(), key=str)


def test_keep_one_by_row(spark):
    """Rows of one doc_id with different texts are judged apart; equal rows are one; blank texts stay."""
    s, other = "one two three four five six seven", "another text of the same id stays here"
    docs = [(1, s), (5, s), (5, other), (5, other), (9, ""), (None, s), (None, "no id but a text of its own here")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, key int")
    got = sorted(((r.doc_id, r.text, r.key) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(1, s, 0), (5, other, 0), (9, "", 0), (None, docs[-1][1], 0)], key=str)


def test_set_trie_links():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(60, rng.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(80)]
    query = sets[0]
    want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 50 * len(np.union1d(s, query))}
    trie = ngram_join.SetTrie(sets)
    assert {i for i, _, _ in trie.walk(query, 50, step=4)} == want
    whole = {i: (n, at.tolist()) for i, n, at in trie.walk(query, 50, whole=True, step=4)}
    assert whole == {i: (len(both := np.intersect1d(s, query)), np.searchsorted(query, both).tolist()) for i, s in enumerate(sets)}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_bpe_as_tiktoken(spark, sf_dir):
    from base64 import b64decode

    ranks = {b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    reference = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (read(spark, sf_dir, "documents"), edge_documents(spark)):
        want = []
        for i, t in texts_of(df):
            ids = reference.encode_ordinary(t)
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert sorted(map(tuple, bpe.token_digests(df, RANKS, public_tokenizers.PATTERN).collect()), key=str) == sorted(want, key=str)


def test_bpe_round_trip_and_offsets(spark):
    df = edge_documents(spark)
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted(t.encode() for _, t in texts_of(df))
    text = {i: t for i, t in texts_of(df)}
    for r in coded.where("doc_id in (8, 4)").collect():
        assert r.starts[0] == 0 and r.ends[-1] == len(text[r.doc_id]) and all(a < b for a, b in zip(r.starts, r.ends, strict=True))


def test_media_round_trip(spark):
    for r in media.media_digests(edge_documents(spark)).collect():
        assert r.payload_bytes % 576 == 0 and r.payload_bytes > 0 and 0 <= r.payload_bytes - r.n_bytes <= 576
    raw = bytes(range(256)) * 45
    payload = media.padded(raw)
    file = media.wrap(payload)
    table = media.track_table(file)
    assert b"".join(file[a:b] for a, b in table["spans"]) == payload and table["samples"] == len(payload) // 576
    assert [file[a:b] for a, b in table["keys"]] == [payload[k * 576 : (k + 1) * 576] for k in range(0, table["samples"], 12)]
    assert media.padded(b"") == b"\xff" * 576 and media.padded(b"a" * 576) == b"a" * 576
    assert media.track_table(file[:100]) is None and media.track_table(b"junk") is None
    indexed = media.container_index(media.media_column(edge_documents(spark))).where("codec = 'raw'").count()
    assert indexed == edge_documents(spark).count()


def test_media_query(spark, sf_dir):
    text = {i: t.encode() for i, t in texts_of(read(spark, sf_dir, "documents"))}
    for r in queries.op7_media_columns(spark, sf_dir).collect():
        p = media.padded(text[r.doc_id])
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id]), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_cws_estimates_generalised_jaccard():
    rng = np.random.default_rng(9)
    terms = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    a, b = rng.integers(0, 6, len(terms)), rng.integers(0, 6, len(terms))
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    s, t = (fingerprints.signature(terms[w > 0], w[w > 0], 4096) for w in (a, b))
    assert abs((s == t).mean() - exact) < 0.04


def test_cws_query(spark, sf_dir):
    docs = sorted(texts_of(read(spark, sf_dir, "documents")))
    got = {r.doc_id: r for r in queries.op1_cws_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    off = []
    grams = lambda t: collections.Counter(tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)))
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(t) // 4
        e = t[: len(t) - q] + u[:q]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        x, y = grams(t), grams(e)
        off.append(abs(got[i].near_edited - sum((x & y).values()) / sum((x | y).values())))
    assert np.mean(off) < 0.06


def test_edge_documents(spark):
    df, none = edge_documents(spark), empty_documents(spark)
    n = df.count()
    for apply in (fingerprints.edit_comparison, fingerprints.fingerprint, suffix_dedup.remove_repeats, ngram_join.ngram_components, media.media_digests):
        assert apply(df).count() == n and apply(none).count() == 0
    assert bpe.token_digests(none, RANKS, public_tokenizers.PATTERN).count() == 0
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    assert fingerprints.edit_comparison(one).first().near_next == 1.0
