"""What only larger tables show: ids that meet, sequences longer than a bucket, expressions and joins that multiply work."""

import datetime

import duckdb
from pyspark.sql import functions as F

from capturelake.operators import carry, gc, threads
from capturelake.plans import catalogue, dumps
from capturelake.sources import captures


def _events(spark, path, users, kind="purchase"):
    at = datetime.datetime(2024, 1, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i), u, kind, 1.0) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")


def test_lock_ids_of_distant_users_meet(spark, tmp_path):
    far = 4096 * 12
    _events(spark, str(tmp_path), [3, 5, far + 7, far + 8, far + 9, 2 * far + 3, 8, far])
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["j2_acquisition_chains"])
    columns = [d[0] for d in want.description]
    want = sorted(want.fetchall())
    assert sorted(map(tuple, dumps.j2_acquisition_chains(spark, str(tmp_path)).select(*columns).collect())) == want
    assert [w[3:] for w in want if w[1] == "0xb000"] == [(2, 3)]


def test_short_and_long_sequences_carry_alike(spark):
    rows = spark.range(40).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 4 == 1, F.col("id") * 7 % 11).alias("v")).union(spark.sql("SELECT 9L, 5L, 2L"))

    def carried(most):
        v = F.col("v")
        got = carry.carried(rows, ["k"], carry.stretch("i", 5), ["i"], most, s=carry.total(v, own=False), m=carry.largest(v), p=carry.latest(v, own=False))
        return sorted(map(repr, map(tuple, got.select("k", "i", "v", "s", "m", "p").collect()))), got

    short, plan = carried(100)
    assert "_bucket" not in plan._jdf.queryExecution().toString()  # no bucket nor join for short sequences
    long, plan = carried(3)
    assert short == long and "_bucket" in plan._jdf.queryExecution().toString()


def test_long_snapshot_is_cut_into_buckets(spark, monkeypatch):
    text = ["Full thread dump VM (1):"] + [x for i in range(6) for x in (f'"t{i}" #{i} tid=0x{i + 1:x}', "   java.lang.Thread.State: RUNNABLE", f"\t- locked <0x{i:x}> (a X)", "")] + ["JNI global refs: 1", "\t- locked <0x99> (a X)"]
    marked = spark.createDataFrame([("a", 0, i + 1, t) for i, t in enumerate(text)], "capture_id string, snapshot_index int, line_no int, text string")
    locks = lambda: sorted(map(tuple, threads.lock_observations(marked).collect()))
    short = locks()
    assert len(short) == 6
    monkeypatch.setattr(carry, "WHOLE", 3)
    monkeypatch.setattr(carry, "WIDTH", 5)
    assert locks() == short
    assert "_bucket" in threads.lock_observations(marked)._jdf.queryExecution().toString()


def test_occupancy_reads_a_message_once(spark):
    assert gc.occupancy(F.col("message"))._jc.toString().count("message") <= 3
    said = spark.createDataFrame([("Pause Young 3M->2M(10M)",), ("Metaspace: 1K->1K(2K)",), ("Pause Full",), ("Heap: 4.0M(8M)->1024K(8M) 5M->6M(7M)",), ("x 10M(5%)->5M(2%)",)], "message string")
    got = [tuple(r.o) if r.o else None for r in said.select(gc.occupancy(F.col("message")).alias("o")).collect()]
    assert got == [(3 << 20, 2 << 20, 10 << 20), None, None, (4 << 20, 1 << 20, 8 << 20), (10 << 20, 5 << 20, None)]


def test_ranges_meet_their_own_lines_only(spark):
    lines = spark.range(1, 2501).select(F.lit("a").alias("capture_id"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("line "), "id").alias("text"))
    tree = captures.hash_tree(lines)
    wanted = captures.roots(tree).join(spark.createDataFrame([(i, i + 2) for i in range(1, 2400, 100)] + [(990, 2010), (2499, 9999), (-3, 1)], "first_line int, last_line int"))
    got = captures.proved_ranges(lines, tree, wanted)
    want = sorted((w.first_line, w.last_line, n, f"line {n}") for w in wanted.collect() for n in range(max(1, w.first_line), min(2500, w.last_line) + 1))
    assert sorted(tuple(r)[1:] for r in got.collect()) == want
    assert not [step for step in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in step and "line_no" in step and ">=" in step]


def test_segments_equal_a_row_by_row_rule_and_are_found_at_once(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = []
    for key in "abcdef":
        at = 0.0
        for line in range(1, 121):
            at = max(0.0, at + rng.choice((50, 50, 900, -300, -700, -4000 if key < "d" else 10)))
            rows.append((key, line, None if rng.random() < 0.2 else at, rng.random() < 0.3, rng.random() < 0.4))
    # a start banner without a clock, events before it and a lower clock after it: the banner begins the segment, the clock does not
    rows += [("z", 1, 9000.0, False, True), ("z", 2, None, True, False), ("z", 3, 10.0, False, True), ("z", 4, 20.0, False, True)]
    want, key = [], None
    for k, line, v, closes, counts in rows:
        if k != key:
            key, session, top, had = k, 0, None, False
        elif (v is not None and top is not None and v < top - 1000.0) or (closes and had):
            session, top, had = session + 1, None, False
        top, had = max((x for x in (top, v) if x is not None), default=None), had or counts
        want.append((k, line, session))
    table = spark.createDataFrame(rows, "k string, line int, v double, c boolean, n boolean").repartition(3)
    assert sorted(map(tuple, gc.segments(table, "k", "line", "v", "c", "n", 1000.0).select("k", "line", "session").collect())) == sorted(want)
    # where values only fall by drops, banners take no round each: inputs, first cuts and one look
    written, cut = [], gc.generic.cut
    monkeypatch.setattr(gc.generic, "cut", lambda df: written.append(1) or cut(df))
    plain = spark.createDataFrame([("a", i, float(i % 50) * 5000, i % 5 == 0, i % 3 == 0) for i in range(1, 200)], "k string, line int, v double, c boolean, n boolean")
    gc.segments(plain, "k", "line", "v", "c", "n", 1000.0).count()
    assert len(written) == 3


def test_unified_lines_are_not_searched_for_older_records(spark):
    lines = spark.createDataFrame([("a", 1, "[1.5s][info][gc] GC(7) Pause Full 3M->2M(10M) 2,5ms"), ("a", 2, "[ 2s ][gc , x] GC(8) Pause Young 1ms"), ("a", 3, "[2024-01-01T00:00:01.250+0000][info][gc,start ] GC(9) y: Pause Young")], "capture_id string, line_no int, text string")
    told = gc.read(lines)
    assert "Window" not in told._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.gc_id, r.message, r.clock, r.clock_ms, r.is_start, r.kind, r.printed_ms, r.heap and r.heap.after) for r in told.orderBy("line_no").collect()]
    assert got == [(7, "Pause Full 3M->2M(10M) 2,5ms", "uptime", 1500.0, False, "pause", 2.5, 2 << 20), (9, "y: Pause Young", "wall", 1704067201250.0, True, "pause", None, None)]


def test_signals_meet_events_of_any_length(spark):
    spans = [(1, 1), (3, 3), (2, 9), (5, 6), (1, 4000), (4095, 4097), (5000, 5001)]
    events = spark.createDataFrame([("a", a, b, float(b * 100), float(b * 100)) for a, b in spans], "capture_id string, line int, end_line int, start_ms double, end_ms double")
    at = [1, 3, 5, 8, 100, 4000, 4096, 4500, 5001]
    signals = spark.createDataFrame([("a", n, -1.0, "x", True) for n in at], "capture_id string, line int, time_ms double, text string, critical boolean")
    got = {r.line: (r.how, r.event_line) for r in gc.signal_events(events, signals).collect()}
    best = lambda n: min(((0 if n == b else 1), b, a) for a, b in spans if a <= n <= b) if any(a <= n <= b for a, b in spans) else None
    assert got == {n: (best(n)[0], best(n)[2]) if best(n) else (None, None) for n in at}


def test_sessions_are_read_from_written_rows(spark, tmp_path):
    _events(spark, str(tmp_path), [1, 2, 3, 4])
    for table in catalogue._session(spark, str(tmp_path)):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.strip().startswith("Relation") and "\n" not in plan.strip()


def test_timeline_ranks_without_a_session_in_one_window(spark):
    from capturelake.operators import series

    rates = spark.createDataFrame([("s", 1, f"k{i}", p, f"t{i}", float(i * p)) for i in range(30) for p in (2, 3)], "session string, first_snapshot int, first_key string, snapshot int, thread_name string, percent double")
    got = series.cpu_timeline(rates, 2)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "count(1) windowspec" not in plan
    assert sorted((r.rank, r.thread_name, r.snapshot, r.available, r.highest) for r in got.collect()) == [(1, "t29", 2, 30, 87.0), (1, "t29", 3, 30, 87.0), (2, "t28", 2, 30, 84.0), (2, "t28", 3, 30, 84.0)]


def test_snapshots_begin_where_a_line_by_line_rule_says(spark):
    import random

    rng = random.Random(11)
    samples = {"B": "Full thread dump X (1):", "S": "2024-01-01 00:00:00", "I": "2024-01-01T00:00:00Z", "P": " 7:", "D": " 42 ", "V": "21.0.1+12", "-": '"t" #1 tid=0x1'}
    shapes = rng.choices(list(samples), k=600)
    at = lambda i: shapes[i] if 0 <= i < len(shapes) else "-"
    want, n = [], 0
    for i, own in enumerate(shapes):
        up, down, down2, down3 = at(i - 1), at(i + 1), at(i + 2), at(i + 3)
        n += (
            (own == "B" and up not in "SI") or (own in "SI" and down == "B" and up != "P") or (own == "P" and down in "SI" and down2 == "B" and up != "I")
            or (own == "I" and down == "P" and down2 in "SI" and down3 == "B") or (own == "D" and down in "SI" and down2 in "VDSI")
        )
        want.append((i + 1, max(0, n - 1)))
    lines = spark.createDataFrame([("a", i + 1, samples[s]) for i, s in enumerate(shapes)], "capture_id string, line_no int, text string").repartition(3)
    for width in (None, 7):
        found = threads.snapshots(lines, width)
        assert sorted((r.line_no, r.snapshot_index) for r in found.collect()) == want
    assert "shape" not in found._jdf.queryExecution().optimizedPlan().toString()  # lines pass no window for their neighbours
