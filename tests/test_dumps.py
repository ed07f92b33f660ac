"""Thread operators on small texts: the shapes that the rendered captures do not have."""

import itertools
import random

from pyspark.sql import functions as F

from capturelake.operators import generic, series, threads
from capturelake.sources import captures

DUMP = """Full thread dump OpenJDK 64-Bit Server VM (21.0.1+12 mixed mode, sharing):

"alpha" #1 prio=5 cpu=1.00ms elapsed=1.00s tid=0x1 nid=0x1 waiting for monitor entry [0x1]
   java.lang.Thread.State: BLOCKED (on object monitor)
\tat app.Config.<clinit>(Config.java:1)
\t- waiting to lock <0xaa> (a app.LockA)

"beta" #2 prio=5 cpu=1.00ms elapsed=1.00s tid=0x1 nid=0x2 in Object.wait() [0x1]
   java.lang.Thread.State: RUNNABLE
\tat java.util.HashMap.get(HashMap.java:1)
\t- waiting on the Class initialization monitor for app.Config

"gamma" #3 prio=5 cpu=1.00ms elapsed=1.00s nid=0x3 runnable [0x1]
   java.lang.Thread.State: RUNNABLE
\t- waiting on the Class initialization monitor for app.Other

Found one Java-level deadlock:
=============================
"alpha":
  waiting to lock monitor 0x1 (object 0xaa, a app.LockA),
  which is held by "beta"
"beta":
  waiting for ownable synchronizer 0xbb, (a app.Sync),
  which is held by "alpha"
"lost":
  waiting to lock monitor 0x3 (object 0xcc, a app.LockC),

Java stack information for the threads listed above:
"beta":
\tat app.Main.run(Main.java:1)"""


def marked(spark):
    return threads.snapshots(captures.lines(spark.createDataFrame([("c", DUMP), ("empty", "")], "capture_id string, text string")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_deadlocks(spark):
    entries = threads.deadlock_entries(marked(spark))
    assert rows(entries, "cycle_id", "entry_no", "thread_name", "waiting_lock_id", "waiting_lock_type", "held_by") == [
        (1, 1, "alpha", "0xaa", "app.LockA", "beta"),
        (1, 2, "beta", "0xbb", "app.Sync", "alpha"),
    ]
    assert rows(threads.deadlock_summary(entries, threads.threads(marked(spark))), "cycles", "entries", "matched_threads") == [(1, 2, 2)]


def test_class_initialization(spark):
    d = marked(spark)
    chains = threads.class_chains(threads.class_initialization(d), threads.threads(d))
    assert rows(chains, "class_name", "waiters", "initializers", "status") == [("app.Config", 1, 1, "stall-candidate"), ("app.Other", 1, 0, "initializer-not-observed")]


def test_runtime_info(spark):
    assert rows(threads.runtime_info(marked(spark)), "vm_name", "vm_version", "vm_info") == [("OpenJDK 64-Bit Server VM", "21.0.1+12", "mixed mode, sharing")]


def test_source_keys_number_repeated_ids(spark):
    keys = series.source_keys(threads.threads(marked(spark)))
    assert rows(keys, "thread_name", "source_key") == [("alpha", "0x1:source:1"), ("beta", "0x1:source:2"), ("gamma", "3")]


def test_links_reject_conflicts_and_ambiguity(spark):
    fields = "session string, snapshot int, source_key string, tid string, jvm_id string, nid string, thread_name string, elapsed_s double"
    data = [
        ("s", 1, "a", "t1", "1", "n1", "x", 1.0), ("s", 2, "a2", "t1", "1", "n9", "x", 2.0),  # another nid
        ("s", 1, "b", "t2", "2", None, "y", 5.0), ("s", 2, "b2", "t2", "2", None, "y", 4.0),  # elapsed time fell
        ("s", 1, "c", "t3", None, "n3", "z", 1.0), ("s", 2, "c2", "t3", None, "n3", "renamed", None),
        ("s", 1, "d", "t4", "4", None, "w", 1.0), ("s", 2, "d2", "t4", None, None, "w", 1.0), ("s", 2, "d3", None, "4", None, "w", 1.0),  # two for one
        ("s", 3, "c3", "t3", None, None, "z", 1.0), ("other", 2, "c9", "t3", None, None, "z", 1.0),
    ]
    table = spark.createDataFrame(data, fields)
    pairs = series.candidates(table)
    links = series.links(pairs)
    assert rows(links, "snapshot", "before_source_key", "source_key") == [(2, "c", "c2"), (3, "c2", "c3")]
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert [r for r in rows(series.series(table, links), "source_key", "first_key") if r[0].startswith("c")] == [("c", "c"), ("c2", "c"), ("c3", "c"), ("c9", "c9")]
    counted = {r.snapshot: r for r in series.change_counts(table, pairs, links).where("session = 's'").collect()}
    assert (counted[2].continued, counted[2].unresolved, counted[2].ended) == (1, 4, None)
    assert (counted[3].continued, counted[3].new, counted[3].ended) == (1, 0, 4)


def test_find_literal_takes_no_pattern(spark):
    lines = spark.createDataFrame([("a.b A.B aXb",), ("none",), (None,), ("",)], "text string")
    assert rows(generic.find_literal(lines, "text", "a.B"), "offset") == [(0,), (4,)]


def test_highlights_and_line_kinds(spark):
    frames = spark.createDataFrame([(["at java.base/java.lang.Object.wait(A)", "at app.A.b(A)"],), (["at java.util.X.y(X)"],)], "frames array<string>")
    shown, kind = threads.highlights(F.col("frames"))
    assert rows(frames, shown, kind) == [(["at app.A.b(A)"], "outside-jdk-packages"), (["at java.util.X.y(X)"], "first-recorded-frames")]
    texts = spark.createDataFrame([(t,) for t in ('"x" #1', "", "--- end ---", " at a.b", "- locked <0x1>", "word")], "t string")
    assert rows(texts, threads.line_kind(F.col("t"))) == [("detail",), ("empty",), ("frame",), ("header",), ("lock",), ("section",)]


def test_diagnostic_trends(spark):
    """Against plain Python over made series: gaps, broken links, unresolved first threads, single rows, blank and repeated diagnostics."""
    rng = random.Random(4)
    table, linked, tried, marks, want = [], [], [], [], set()
    for i in range(150):
        places = sorted(rng.sample(range(1, 9), rng.randint(1, 6))) if i % 3 == 0 else list(range(start := rng.randint(1, 4), start + rng.randint(1, 6)))
        unsure, cut = i % 11 == 0, rng.choice(places[1:] or [None]) if i % 5 == 0 else None
        names = [f"t{i}-{p}" for p in places]
        table += [("s", p, name, places[0], names[0]) for p, name in zip(places, names)]
        for j, (p, name) in enumerate(zip(places, names)):
            if j and p == places[j - 1] + 1 and p != cut:
                linked.append(("s", p, name, names[j - 1]))
                tried.append(("s", p, name, names[j - 1], True))
        if unsure:
            tried.append(("s", places[0], names[0], "other", False))
        if unsure:
            status = "identity-unavailable"
        elif len(places) < 2:
            status = "insufficient-data"
        else:
            breaks = ["snapshot-gap" if b != a + 1 else "identity-unavailable" for a, b in zip(places, places[1:]) if b != a + 1 or b == cut]
            status = (breaks or ["available"])[0]
        for diagnostic in ("blocked", "busy"):
            on = [rng.random() < 0.6 for _ in places]
            marks += [("s", p, name, diagnostic) for p, name, x in zip(places, names, on) if x for _ in range(rng.randint(1, 2))]
            if any(on):
                runs = [(x, len(list(g))) for x, g in itertools.groupby(on)]
                trend = "insufficient-data" if status != "available" else "growing" if on[-1] > on[0] else "shrinking" if on[-1] < on[0] else "stable"
                seen = [p for p, x in zip(places, on) if x]
                want.add(("s", places[0], names[0], diagnostic, len(places), status, sum(on), len(runs) - 1, max(n for x, n in runs if x), runs[-1][1] * runs[-1][0], seen[0], seen[-1], trend))
        marks += [("s", places[0], names[0], " "), ("s", places[0], names[0], None), ("s", 99, names[0], "blocked")]
    rows_ = spark.createDataFrame(table, "session string, snapshot int, source_key string, first_snapshot int, first_key string")
    accepted = spark.createDataFrame(linked, "session string, snapshot int, source_key string, before_source_key string")
    pairs = spark.createDataFrame(tried, "session string, snapshot int, source_key string, before_source_key string, fits boolean")
    got = series.diagnostic_trends(series.continuity(rows_, pairs, accepted), spark.createDataFrame(marks, "session string, snapshot int, source_key string, diagnostic string"))
    columns = "session first_snapshot first_key diagnostic total status present transitions longest current first_observed last_observed trend".split()
    found = [tuple(r) for r in got.select(*columns).collect()]
    assert set(found) == want and len(found) == len(want)
    assert {r[-1] for r in found} == {"growing", "shrinking", "stable", "insufficient-data"} and {r[5] for r in found} == {"available", "snapshot-gap", "identity-unavailable", "insufficient-data"}


def test_cpu_timeline(spark):
    """Renamed series, two of one name, a search, ties and a limit."""
    points = [("s", 1, "a", 2, "old", 5.0), ("s", 1, "a", 3, "Pool-1", 50.0), ("s", 2, "b", 3, "pool-1", 50.0), ("s", 2, "b", 4, "pool-1", 5.0), ("s", 4, "c", 5, "other", 90.0), ("s", 1, "d", 2, "pool-2", 7.0), ("t", 1, "a", 2, "POOL", 1.0)]
    rates = spark.createDataFrame(points, "session string, first_snapshot int, first_key string, snapshot int, thread_name string, percent double")
    found = lambda *limits: sorted((r.session, r["rank"], r.first_key, r.snapshot, r.available, r.samples, r.mean) for r in series.cpu_timeline(rates, *limits).collect())
    assert found(2, " pool") == [("s", 1, "a", 2, 3, 2, 27.5), ("s", 1, "a", 3, 3, 2, 27.5), ("s", 2, "b", 3, 3, 2, 27.5), ("s", 2, "b", 4, 3, 2, 27.5), ("t", 1, "a", 2, 1, 1, 1.0)]
    assert [r[:4] for r in found(0)] == [("s", 1, "c", 5), ("t", 1, "a", 2)] and len(found(99)) == 7
    assert found(5, "absent") == []
