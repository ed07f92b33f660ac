"""Operators without SQL against plain Python: ranges, excerpts, stack scores, leader clusters, segments, strong components."""

import random
import re

from pyspark.sql import functions as F

from capturelake.operators import clusters, gc, generic, patterns, threads
from capturelake.sources import captures


def hits(text, words):
    out = []
    for w in words:
        pattern = rf"(?<!\w){w}(?!\w)" if w.isdigit() else w
        out += [(m.start(), m.end(), w) for m in re.finditer(pattern, text, re.IGNORECASE)]
    return sorted(out, key=lambda h: (h[0], -h[1]))


TEXTS = ["The theme of the 4 thesis: 44 is not 4.", "nothing", "", "aTHEthe 4" + " x" * 200 + " the 4 theme thesis", None, "É the é"]


def test_ranges_and_excerpts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    words = ["the", "4", "hesi"]
    want, best = set(), {}
    for k, t in enumerate(TEXTS):
        merged = []
        for a, b, _ in hits(t or "", words):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want |= {(k, a, b) for a, b in merged}
        starts = {max(0, a - 65) for a, _, _ in hits(t or "", words)}
        if starts:
            n = lambda s, t=t: len({w for a, b, w in hits(t, words) if a >= s and b <= s + 240})
            at = min(starts, key=lambda s: (-n(s), s))
            best[k] = (at, n(at), t[at : at + 240])
    assert {tuple(r) for r in generic.match_ranges(docs, "k", "t", "the 4 hesi").select("k", "start", "end").collect()} == want
    assert {r.k: (r.start, r.words, r.excerpt) for r in generic.best_excerpt(docs, "k", "t", "the 4 hesi").collect()} == best


def score(a, b, pa, pb):
    if a and a == b:
        return 1.0, "normalized-exact"
    ha, hb, n = a[:12], b[:12], max(len(a[:12]), len(b[:12]), 1)
    start = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    tail_len = start(a[::-1][:12], b[::-1][:12])
    run = max((k for i in range(len(ha)) for j in range(len(hb)) for k in range(1, 13) if ha[i : i + k] == hb[j : j + k] and len(ha[i : i + k]) == k), default=0)
    at, ordered = 0, 0
    for x in ha:
        if x in hb[at:]:
            at, ordered = at + hb[at:].index(x) + 1, ordered + 1
        else:
            at = len(hb)
    overlap = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if set(x) | set(y) else 1.0
    part = {"prefix": start(a[:6], b[:6]) / max(len(a[:6]), len(b[:6]), 1), "tail": tail_len / n, "ordered": ordered / n, "overlap": overlap(ha, hb), "app": overlap(pa[:8], pb[:8]), "run": run / n}
    mixed = {m: sum(part[k] * w for k, w in ws.items()) for m, ws in clusters.MIXES.items()}
    method = max(mixed, key=lambda m: round(mixed[m], 12))
    if method == "common-tail" and tail_len < 2 and run >= 4:
        return mixed["shifted-subsequence"], "shifted-subsequence"
    if method == "frame-overlap" and len(set(ha) & set(hb)) < 2:
        return min(mixed[method], 0.55), "variant-merge"
    return mixed[method], method


def test_stack_scores_and_leaders(spark):
    rng = random.Random(4)
    frames = [f"app.F{i}" for i in range(9)] + ["java.A", "java.B"]
    stacks = [[rng.choice(frames) for _ in range(rng.randrange(1, 16))] for _ in range(40)]
    stacks += [s[1:] + ["app.Tail"] for s in stacks[:10] if len(s) > 1]
    app = lambda s: [f for f in s if f.startswith("app")]
    table = spark.createDataFrame([("s", str(i), s, app(s)) for i, s in enumerate(stacks)], "session string, shape string, frames array<string>, app array<string>")
    scored = clusters.similarity(clusters.candidates(table)).cache()
    got = {(int(r.shape), int(r.leader)): (r.score, r.method) for r in scored.collect()}
    for (i, j), (value, method) in got.items():
        want = score(stacks[i], stacks[j], app(stacks[i]), app(stacks[j]))
        assert abs(value - want[0]) < 1e-9 and (method == want[1] or stacks[i] == stacks[j] or abs(value - want[0]) < 1e-9)
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"))
    order = [rng.randrange(len(stacks)) for _ in range(150)]
    leaders, want = [], {}
    for place, shape in enumerate(order):
        options = [(got[shape, s][0], -p, got[shape, s][1]) for p, s in leaders if (shape, s) in got]
        best = max(options, default=None)
        if best is None or best[0] < clusters.JOINS or best[2] == "common-tail" and best[0] < clusters.TAIL_JOINS:
            leaders.append((place, shape))
            want[place] = place
        else:
            want[place] = -best[1]
    rows = spark.createDataFrame([("s", str(shape), place) for place, shape in enumerate(order)], "session string, shape string, place int")
    assert {r.place: r.leader_place for r in clusters.leader_clusters(rows, scored).collect()} == want
    assert len(leaders) > 1


def test_strong_components_and_long_chains(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"))
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8)]
    table = spark.createDataFrame(edges, "source long, target long")
    assert {r.node for r in generic.in_cycles(table).collect()} == {1, 2, 3, 4, 5, 6}
    assert {r.node: r.depth for r in generic.depths(table).collect()} == {1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 0, 7: 3, 8: 0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(10)], "source long, target long")
    assert generic.reach(chain).count() == 55 and generic.depths(chain).agg(F.max("depth")).first()[0] == 10


LOG = """[0.1s][info][gc,init] Using Serial
[1.0s][info][gc,start] GC(0) Pause Young (Allocation Failure)
[1.2s][info][gc] GC(0) Pause Young (Allocation Failure) 20M->4M(32M) 10.5ms
[5.0s][info][gc] GC(1) Garbage Collection (Proactive) 20M(10%)->4M(2%)
0.5: [GC pause (G1 Evacuation Pause) (young), 0.0100000 secs]
   [Eden: 10.0M(10.0M)->0.0B(9.0M) Survivors: 0.0B->1024.0K Heap: 10.0M(20.0M)->1536.0K(20.0M)]
0.6: [GC concurrent-root-region-scan-start]
0.7: [Full GC (Ergonomics) [PSYoungGen: 5K->0K(10K)"""


def test_collector_log_by_hand(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir"))
    lines = captures.lines(spark.createDataFrame([("c", LOG)], "capture_id string, text string"))
    got = sorted(gc.events(lines).select("line", "end_line", "kind", "duration_ms", "heap_before", "heap_after", "heap_capacity").collect())
    mb = 1 << 20
    assert [tuple(r)[:3] for r in got] == [(2, 3, "pause"), (4, 4, "cycle"), (5, 6, "pause")]
    assert [r.duration_ms for r in got] == [10.5, None, 10.0]
    assert [(r.heap_before, r.heap_after, r.heap_capacity) for r in got] == [(20 * mb, 4 * mb, 32 * mb), (20 * mb, 4 * mb, None), (10 * mb, 1.5 * mb, 20 * mb)]
    placed = gc.session_lines(lines)
    assert [(r.session, r.collector) for r in gc.sessions(placed).orderBy("session").collect()] == [(0, "Serial"), (1, "G1")]
    notes = gc.warnings(lines, placed).first()
    assert notes.segments == 2 and {"several segments", "incomplete record", "mixed formats"} <= set(notes.warnings)


def test_allocation_bounds_and_unknown_sizes(spark):
    one = spark.createDataFrame([("12",), ("3K",), ("1.5M",), ("odd",), (None,)], "p string").select(threads.allocation_bounds(F.col("p")).alias("b")).collect()
    assert [r.b and (r.b.minimum, r.b.maximum) for r in one] == [(12, 12), (3072, 4095), (1468006, 1677721), None, None]


def test_pattern_points(spark):
    q, g, s, p = "at java.base@21/java.util.concurrent.LinkedBlockingQueue.take(L.java:1)", "at java.util.concurrent.ThreadPoolExecutor.getTask(T.java:2)", "at java.lang.Thread.sleep(Native Method)", "at java.util.concurrent.locks.LockSupport.parkNanos(L.java:3)"
    rows = [(1, [q, g], "WAITING", None), (2, [g], "RUNNABLE", None), (3, [s, p], "TIMED_WAITING", "sleeping"), (4, [p], "WAITING", "parking"), (5, [], "WAITING", "parking"), (6, [], "RUNNABLE", None)]
    got = {r.k: [(p.key, p.score, p.confidence) for p in r.patterns] for r in patterns.scored(spark.createDataFrame(rows, "k int, frames array<string>, java_state string, state_detail string")).collect()}
    assert got == {
        1: [("executor-idle", 100, "high")], 2: [("executor-idle", 45, "low")], 3: [("sleeping", 85, "high"), ("parked", 85, "high")], 4: [("parked", 95, "high")], 5: [("parked", 80, "medium")], 6: [],
    }
    told = patterns.scenario(patterns.scored(spark.createDataFrame(rows, "k int, frames array<string>, java_state string, state_detail string")).withColumn("cpu_hot", F.col("k") == 6).withColumn("carrier", F.col("k") == 2))
    assert [r.scenario for r in told.orderBy("k").collect()] == ["executor-idle", "carrier-thread", "sleeping", "parked", "parked", "cpu-hot"]
