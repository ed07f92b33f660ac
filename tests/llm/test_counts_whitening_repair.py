"""Token counts against the library, whitening against a dense solver, conversation repair against a plain search."""

import collections
import hashlib
import heapq
import math
import random
import re
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from capturelake.llm import conversations, queries, token_counts, whitening
from capturelake.llm.common import read
from tests.llm.cases import LONG, edge_documents, empty_documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def library_counts(rows):
    library = Tokenizer.from_file(VOCABULARY)
    out = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        out.append((i, len((t or "").encode()), n, n > 512))
    return sorted(out, key=str)


def test_token_counts_equal_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    assert sorted(map(tuple, queries.op11_token_counts(spark, sf_dir).collect()), key=str) == library_counts(rows)


def test_token_counts_on_edges(spark, monkeypatch):
    docs = edge_documents(spark)
    more = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b  \n", "  <|endoftext|>  x", "<|endoftext", "I'll we've   'S", "\U0002cea5࢏ ab࢏c 1౜", "x" * 3000, " \t\n" * 900, "\x00\x1c\x1f é é", None, ""]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True).repartition(3)
    want = library_counts([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, token_counts.token_counts(docs, VOCABULARY).collect()), key=str) == want
    assert token_counts.token_counts(empty_documents(spark), VOCABULARY).collect() == []
    renamed = docs.withColumnRenamed("doc_id", "row_no").selectExpr("*", "text AS block", "row_no AS piece", "row_no AS at")
    assert sorted(map(tuple, token_counts.token_counts(renamed, VOCABULARY, key="row_no").collect()), key=str) == want


def test_blocks_and_slices_do_not_change_counts(monkeypatch):
    splitter = token_counts.PreTokens(VOCABULARY)
    whole = splitter.frequencies(LONG)
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 100)
    monkeypatch.setattr(token_counts, "SLICE", 7)
    assert splitter.frequencies(LONG) == whole


def test_splits_agree_on_every_long_assigned_character():
    splitter = token_counts.PreTokens(VOCABULARY)
    known = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Co") and not 0x3400 <= c <= 0xD7A3 and not 0x20000 <= c <= 0x2A6FF]
    known += [0x3400, 0x4E00, 0x9FA5, 0xAC00, 0xD7A3, 0x20000, 0x2A6D6, 0xE000, 0xF0000]
    for at in range(0, len(known), 4000):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}x " for c in known[at : at + 4000])
        assert not splitter.recent.search(text)
        assert [m.span() for m in splitter.pattern.finditer(text)] == [s for _, s in splitter.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def dense(rows, most=8):
    """Rows of (vec_id, x) by plain numbers: n, deviations, eigenvalues and the projections of the largest components."""
    x = [r[1] for r in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    dev = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    centred = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, dev, e, e / np.trace(cov), centred @ v / np.sqrt(e)


def compare(got, rows, most=8, places=1e-7):
    n, dev, e, explained, projected = dense(rows, most)
    by = collections.defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert sorted(by) == list(range(1, len(e) + 1))
    for k, part in by.items():
        part.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, dev[i]))
        assert [(r.vec_id, r.n, r.deviation) for r in part] == [(rows[i][0], n, dev[i]) for i in order]
        w, want = np.array([r.whitened for r in part]), projected[order, k - 1]
        assert np.abs(w - want * np.sign(w @ want)).max() < places
        assert all(math.isclose(r.explained, explained[k - 1], rel_tol=1e-10) for r in part)
        assert all(r.identity_error < 1e-9 for r in part)


def scaled(vector):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in vector]


def test_whitening_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, [math.floor(1024 * c) + 100_000 for c in r.embedding]) for r in read(spark, sf_dir, "embeddings").collect()]
    compare(queries.op12_feast_whitening(spark, sf_dir).collect(), rows)


def test_whitening_on_edges(spark):
    kind = "vec_id long, embedding array<float>, label int, x string, c string"
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [9, 5, 2, 1, 0.5]).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (7, [0.5] * 5), (7, [0.5] * 5)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0]), (52, [float("nan")] + [0.0] * 4), (53, [float("-inf")] + [0.0] * 4), (54, []), (55, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x", "c") for i, v in rows + bad], kind).repartition(3)
    compare(whitening.whiten(df).collect(), [(i, scaled(v)) for i, v in rows])
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "", "")], kind)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 3.0, float(i)], 0, "", "") for i in range(9)], kind)  # one direction only
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and all(math.isclose(r.explained, 1) and r.identity_error < 1e-9 for r in got)


def test_contours_find_ties_and_close_values(spark):
    rng = np.random.default_rng(8)
    for values in ([5.0, 5, 5, 5, 5, 5, 3, 3, 1, 0.1], [1.0, 1 - 1e-9, 1 - 2e-9, 0.5, 0.5, 0.4, 1e-3, 1e-6, 1e-9, 0], list(np.linspace(9, 1, 30)), [2.0] * 6, [7.0]):
        d = len(values)
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        v = q @ np.diag(values) @ q.T
        v = (v + v.T) / 2
        inertia = whitening.Inertia(v)
        assert [inertia.above(s) for s in (10, 4.5, 0.95, -1)] == [sum(x > s for x in values) for s in (10, 4.5, 0.95, -1)]
        got = whitening.principal_components(spark, v, 8)
        want = [x for x in sorted(values, reverse=True)[:8] if x > 1e-10]
        assert np.allclose(got.values[: len(want)], want, rtol=0, atol=1e-13 * max(values) * 10)
        assert np.abs(got.vectors.T @ got.vectors - np.eye(len(got.values))).max() < 1e-6
        assert np.abs(v @ got.vectors - got.vectors * got.values).max() < 1e-11 * max(values)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (50, 2**20, 2**27, 2**40):
        y = rng.integers(-top, top, (130, 3))
        assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def plain_repair(rows):
    """The contract by plain means: rows are (turn, role, text) of one conversation before damage, with its id."""
    conv, original = rows
    shown = lambda v: " " if v is None else str(v)
    after = []
    for turn, role, text in original:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after += [(turn, role, text)] * (2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in after:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    legal = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while True:  # cheapest first, ASCII-least among them
        cost, audit, i, initials, out = heapq.heappop(heap)
        tail = (i, initials[-2:] if len(initials) > 2 else initials)
        if i == len(after) and legal.fullmatch(initials):
            break
        if (tail, cost, audit) in done:
            continue
        done.add((tail, cost, audit))
        for role in ("user", "assistant"):
            if prefix.fullmatch(initials + role[0]):
                heapq.heappush(heap, (cost + 2, audit + "I", i, initials + role[0], (*out, f"{role}:")))
        if i < len(after):
            _, role, text = after[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, out))
            if faults[i] not in (1, 2):
                extra = int(faults[i] == 3)
                if role[:1] and prefix.fullmatch(initials + role[0]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initials + role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if prefix.fullmatch(initials + new[0]):
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, initials + new[0], (*out, f"{new}:{text}")))
    turns = sorted({t for t, _, _ in after if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    marks = [r[1][:1] for r in after]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
    return (conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_conversation(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role, text))
    return out.items()


def test_repair_of_short_conversations(spark, sf_dir):
    rows = [tuple(r) for r in read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    short = [r for r in by_conversation(rows) if len(r[1]) <= 14]
    got = {r.conv_id: tuple(r) for r in queries.op13_conversation_repair(spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in rows} and len(short) > 10
    assert [got[conv] for conv, _ in short] == [plain_repair(r) for r in short]


@pytest.mark.parametrize("piece", [1, 3, 50_000])
def test_repair_of_made_conversations(spark, piece, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng = random.Random(11)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 8)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None])
                rows.append((conv, rng.choice([turn, turn, turn * 2, None]), role, rng.choice(["Yes.", "no", "", None, " \t\n", "What? ", "what\r\n", f"Text {rng.random()}.", "é…"])))
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, fault int").repartition(3)
    got = sorted((tuple(r) for r in conversations.repaired(df).collect()), key=str)
    assert got == sorted((plain_repair(r) for r in by_conversation(rows)), key=str)
    assert conversations.repaired(df.limit(0)).collect() == []


def test_a_giant_conversation_goes_through_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE", 1_000)
    rows = [(5, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(30_000)]
    got = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert len(got) == 1 and len(got[0].audit) >= 29_000
    after = [t for t in range(30_000) if zlib.crc32(f"5:{t}".encode()) % 20]
    assert got[0].gaps == 30_000 - len(after) - (29_999 - after[-1]) - after[0]
    marks = [m for t in range(30_000) if (k := zlib.crc32(f"5:{t}".encode()) % 20) for m in [("u" if k == 4 else "ua"[t % 2], {1: 1, 2: 3}.get(k, 0)), ("", 2)][: 1 + (k == 3)]]
    costs = {"": 0, "u": 2, "a": 4}  # cheapest ways to each last role, insertions closed
    for mark, fault in marks:
        new = {q: c + 3 for q, c in costs.items()}
        for q, c in costs.items():
            to = "a" if q == "u" else "u"
            if fault not in (1, 2):
                new[to] = min(new[to], c + (fault == 3) + 2 * (mark != to))
        for q in "uau":
            new[q] = min(new[q], 2 + new["a" if q == "u" else "u"], new[""] + (2 if q == "u" else 4))
        costs = new
    assert got[0].cost == min(costs[""], costs["a"], costs["u"] + 2)
