"""All registered queries of the diagnostics engine with their SQL.

The captures are rendered from the events table as text and extracted again; the SQL computes the answers from the
events alone and never sees the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import gc, generic, series, threads, tls
from capturelake.plans import rendered
from capturelake.sources import captures

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BASE_US = rendered.EPOCH_US
_E = f"e AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) - {BASE_US} AS us, CAST(round(value * 100) AS BIGINT) AS n FROM events)"
_GC = f"WITH {_E}, g AS (SELECT CAST(user_id AS VARCHAR) AS capture_id, event_id AS gc_id, CASE event_type WHEN 'error' THEN 'stall' WHEN 'click' THEN 'cycle' ELSE 'pause' END AS kind, event_type, greatest(0, us - n) AS start_us, greatest(us, n) AS end_us, n, us, CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN event_id % 97 + 1 END AS after_mb FROM e)"
_DAY = f"WITH {_E}, t AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, user_id, arg_max(event_type, us) AS kind, count(*) AS m, sum(n) AS cpu FROM e GROUP BY ALL), t2 AS (SELECT *, CASE kind WHEN 'click' THEN 'WAITING' WHEN 'purchase' THEN 'TIMED_WAITING' WHEN 'error' THEN 'BLOCKED' ELSE 'RUNNABLE' END AS java_state FROM t), w AS (SELECT capture_id, user_id AS waiter, user_id // 2 AS lock FROM t WHERE kind = 'error'), h AS (SELECT t.capture_id, t.user_id FROM t WHERE NOT (kind = 'error' AND user_id = user_id // 2))"
_TLS = f"WITH {_E}, r AS (SELECT CAST(user_id % 20 AS VARCHAR) AS capture_id, lower(printf('%x', user_id)) AS tid, event_type, (us + {BASE_US}) // 1000 AS ms, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS interaction FROM e), i AS (SELECT capture_id, tid, CAST(interaction AS BIGINT) AS interaction, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS records, CASE WHEN bool_or(event_type = 'error') THEN 'failure' WHEN bool_or(event_type = 'purchase') THEN 'success' ELSE 'unknown' END AS outcome FROM r GROUP BY ALL)"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gc_lines(spark, sf_dir):
    return generic.cut(rendered.lines(rendered.gc_logs(_table(spark, sf_dir, "events"))))


def _gc_events(spark, sf_dir):
    return generic.cut(gc.events(_gc_lines(spark, sf_dir)))


def _dump(spark, sf_dir):
    return generic.cut(threads.snapshots(generic.cut(rendered.lines(rendered.thread_dumps(_table(spark, sf_dir, "events")), rendered.USERS))))


def _tls_records(spark, sf_dir):
    return generic.cut(tls.records(generic.cut(rendered.lines(rendered.tls_logs(_table(spark, sf_dir, "events"))))))


def _tls(spark, sf_dir):
    return tls.interactions(_tls_records(spark, sf_dir))


def _us(c):
    return F.round(F.col(c) * 1000).cast("long")


def _checkpoints(spark):
    generic.checkpoint_folder(spark.sparkContext)


# --- sources -----------------------------------------------------------------


@query("s4_lines", f"WITH {_E} SELECT CAST(user_id AS VARCHAR) AS capture_id, count(*) + count(*) FILTER (WHERE event_type = 'click') AS n_lines FROM e GROUP BY 1")
def s4_lines(spark, sf_dir):
    return _gc_lines(spark, sf_dir).groupBy("capture_id").agg(F.count("*").alias("n_lines"))


@query("s5_evidence_ranges", "SELECT CAST(user_id AS VARCHAR) AS capture_id, least(3, count(*) + count(*) FILTER (WHERE event_type = 'click')) AS n_lines FROM events GROUP BY user_id")
def s5_evidence_ranges(spark, sf_dir):
    lines = _gc_lines(spark, sf_dir)
    wanted = lines.select("capture_id").distinct().select("capture_id", F.lit(1).alias("first_line"), F.lit(3).alias("last_line"))
    return captures.ranges(lines, wanted).groupBy("capture_id").agg(F.count("*").alias("n_lines"))


@query(
    "s5_gc_event_ranges",
    _GC + ", v AS (SELECT user_id, event_id, us, 1 AS part, '[' || us || 'us][info][gc] GC(' || event_id || ') ' AS line FROM e UNION ALL SELECT user_id, event_id, us - n, 0, '[' || (us - n) || 'us][info][gc,start] GC(' || event_id || ') ' FROM e WHERE event_type = 'click'), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, part, line) AS line_no FROM v) SELECT CAST(user_id AS VARCHAR) AS capture_id, event_id AS gc_id, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line, max(line_no) - min(line_no) + 1 AS n_lines, count(*) AS own_lines FROM o GROUP BY ALL",
)
def s5_gc_event_ranges(spark, sf_dir):
    lines = _gc_lines(spark, sf_dir)
    tree = generic.cut(captures.hash_tree(lines))
    found = generic.cut(gc.events(lines).select("capture_id", "gc_id", F.col("line").alias("first_line"), F.col("end_line").alias("last_line")))
    met = captures.proved_ranges(lines, tree, found.join(captures.roots(tree), "capture_id")).join(found, ["capture_id", "first_line", "last_line"])
    own = F.contains("text", F.concat(F.lit(" GC("), F.col("gc_id").cast("string"), F.lit(") ")))
    return met.groupBy("capture_id", "gc_id", "first_line", "last_line").agg(F.count("*").alias("n_lines"), F.count_if(own).alias("own_lines"))


# --- collector logs ----------------------------------------------------------


@query("e7_gc_events", _GC + " SELECT capture_id, gc_id, kind, n AS duration_us, start_us, end_us, after_mb, event_type = 'purchase' AS \"full\", event_type = 'purchase' AS explicit FROM g")
def e7_gc_events(spark, sf_dir):
    e = gc.events(_gc_lines(spark, sf_dir))
    return e.select("capture_id", "gc_id", "kind", _us("duration_ms").alias("duration_us"), _us("start_ms").alias("start_us"), _us("end_ms").alias("end_us"), (F.col("heap_after") / 1048576).cast("long").alias("after_mb"), "full", "explicit")


@query("e5_heap_occupancy", _GC + " SELECT capture_id, gc_id, after_mb + gc_id % 31 AS before_mb, after_mb, 100 AS capacity_mb FROM g WHERE kind = 'pause'")
def e5_heap_occupancy(spark, sf_dir):
    mb = lambda c: (F.col(c) / 1048576).cast("long")
    return gc.events(_gc_lines(spark, sf_dir)).where("heap_capacity IS NOT NULL").select("capture_id", "gc_id", mb("heap_before").alias("before_mb"), mb("heap_after").alias("after_mb"), mb("heap_capacity").cast("int").alias("capacity_mb"))


@query("j16_gc_start_completion", _GC + " SELECT capture_id, count(*) FILTER (WHERE kind = 'cycle') AS matched, count(*) FILTER (WHERE kind <> 'cycle') AS alone FROM g GROUP BY 1")
def j16_gc_start_completion(spark, sf_dir):
    return gc.events(_gc_lines(spark, sf_dir)).groupBy("capture_id").agg(F.count_if(F.col("line") < F.col("end_line")).alias("matched"), F.count_if(F.col("line") == F.col("end_line")).alias("alone"))


_UNION = "p AS (SELECT *, max(end_us) OVER (PARTITION BY capture_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WHERE kind = 'pause'), u AS (SELECT capture_id, sum(greatest(0, end_us - greatest(start_us, coalesce(reach, start_us)))) AS covered FROM p GROUP BY 1)"


@query(
    "a15_gc_pause_stats",
    _GC + f", {_UNION} SELECT g.capture_id, count(*) FILTER (WHERE kind = 'pause') AS pauses, CAST(coalesce(sum(n) FILTER (WHERE kind = 'pause'), 0) AS BIGINT) AS total_us, max(n) FILTER (WHERE kind = 'pause') AS max_us, CAST(quantile_disc(n, 0.95) FILTER (WHERE kind = 'pause') AS BIGINT) AS p95_us, max(end_us) - min(start_us) AS observed_us, CAST(any_value(coalesce(covered, 0)) AS BIGINT) AS covered_us, count(after_mb) AS heap_samples FROM g LEFT JOIN u USING (capture_id) GROUP BY g.capture_id",
)
def a15_gc_pause_stats(spark, sf_dir):
    s = gc.pause_stats(_gc_events(spark, sf_dir))
    return s.select("capture_id", "pauses", _us("total_pause_ms").alias("total_us"), _us("max_pause_ms").alias("max_us"), _us("p95_pause_ms").alias("p95_us"), _us("observed_ms").alias("observed_us"), F.coalesce(_us("covered"), F.lit(0)).alias("covered_us"), "heap_samples")


@query("w10_pause_union", _GC + f", {_UNION} SELECT capture_id, CAST(covered AS BIGINT) AS covered_us FROM u")
def w10_pause_union(spark, sf_dir):
    return gc.interval_union(_gc_events(spark, sf_dir).where("kind = 'pause'"), "capture_id", "start_ms", "end_ms").select("capture_id", _us("covered").alias("covered_us"))


_FINDINGS = ", f AS (SELECT capture_id, 'pause-budget' AS rule, 'warning' AS severity FROM g WHERE kind = 'pause' AND n > 5000 UNION ALL SELECT capture_id, 'full', 'info' FROM g WHERE event_type = 'purchase' UNION ALL SELECT capture_id, 'occupancy', 'warning' FROM g WHERE after_mb >= 90 UNION ALL SELECT capture_id, 'jvm-signal', 'critical' FROM g WHERE kind = 'stall')"


def _findings(spark, sf_dir):
    lines = _gc_lines(spark, sf_dir)
    return gc.findings(generic.cut(gc.events(lines)), generic.cut(gc.signals(lines)), budget_ms=5.0)


@query("a16_gc_findings", _GC + _FINDINGS + " SELECT capture_id, rule, severity, count(*) AS n FROM f GROUP BY ALL")
def a16_gc_findings(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("capture_id", "rule", "severity").agg(F.count("*").alias("n"))


@query("a17_gc_capture_summary", _GC + _FINDINGS + " SELECT capture_id, count(*) FILTER (WHERE rule = 'pause-budget') AS over_budget, count(*) FILTER (WHERE severity = 'critical') AS critical, bool_or(rule IN ('occupancy', 'jvm-signal')) AS pressure, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'info' END AS headline FROM f GROUP BY 1")
def a17_gc_capture_summary(spark, sf_dir):
    return gc.capture_summary(_findings(spark, sf_dir))


@query("a18_gc_kind_census", _GC + " SELECT kind, count(*) AS n FROM g GROUP BY 1")
def a18_gc_kind_census(spark, sf_dir):
    return gc.events(_gc_lines(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query("e8_gc_signals", _GC + " SELECT capture_id, us AS time_us, TRUE AS critical FROM g WHERE kind = 'stall'")
def e8_gc_signals(spark, sf_dir):
    return gc.signals(_gc_lines(spark, sf_dir)).select("capture_id", _us("time_ms").alias("time_us"), "critical")


@query("j15_gc_signal_event", _GC + " SELECT capture_id, start_us, count(*) AS n FROM g WHERE kind = 'stall' GROUP BY ALL")
def j15_gc_signal_event(spark, sf_dir):
    return _findings(spark, sf_dir).where("rule = 'jvm-signal'").groupBy("capture_id", _us("start_ms").alias("start_us")).agg(F.count("*").alias("n"))


@query("p6_gc_event_filter", _GC + " SELECT capture_id, gc_id FROM g WHERE kind = 'pause' AND event_type = 'view' AND (n > 5000 OR after_mb >= 90)")
def p6_gc_event_filter(spark, sf_dir):
    lines = _gc_lines(spark, sf_dir)
    e = generic.cut(gc.events(lines))
    return e.where("contains(label, 'Young')").join(gc.findings(e, generic.cut(gc.signals(lines)), 5.0), ["capture_id", "line"], "left_semi").select("capture_id", "gc_id")


@query("w12_gc_event_window", _GC + " SELECT capture_id, gc_id, min(start_us) OVER w AS from_us, max(end_us) OVER w AS to_us FROM g WINDOW w AS (PARTITION BY capture_id ORDER BY start_us, us ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def w12_gc_event_window(spark, sf_dir):
    return gc.neighbours(_gc_events(spark, sf_dir)).select("capture_id", "gc_id", _us("from_ms").alias("from_us"), _us("to_ms").alias("to_us"))


@query("a22_gc_overview", _GC + " SELECT capture_id, max(n) AS longest_us FROM g WHERE kind = 'pause' GROUP BY 1")
def a22_gc_overview(spark, sf_dir):
    return gc.overview(_gc_events(spark, sf_dir)).groupBy("capture_id").agg(F.max("longest_ms").alias("longest_ms")).select("capture_id", _us("longest_ms").alias("longest_us"))


@query("a22_gc_overview_bins", _GC + ", b AS (SELECT capture_id, min(start_us) AS lo, max(end_us) AS hi FROM g GROUP BY 1) SELECT capture_id, CAST(least(399, floor((start_us / 1000.0::DOUBLE - lo / 1000.0::DOUBLE) / (hi / 1000.0::DOUBLE - lo / 1000.0::DOUBLE) * 400)) AS INTEGER) AS bin, max(n) AS longest_us FROM g JOIN b USING (capture_id) WHERE kind = 'pause' GROUP BY ALL")
def a22_gc_overview_bins(spark, sf_dir):
    return gc.overview(_gc_events(spark, sf_dir)).select("capture_id", "bin", _us("longest_ms").alias("longest_us"))


# --- thread dumps ------------------------------------------------------------


@query("t3_threads", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name, CAST(user_id + 1 AS VARCHAR) AS jvm_id, user_id % 4 = 0 AS daemon, 5 AS prio, CAST(cpu AS BIGINT) AS cpu_ms, m AS elapsed_s, java_state, 2 AS n_frames, 'at app.Handler' || m % 7 || '.run(Handler.java:' || user_id || ')' AS top_frame FROM t2")
def t3_threads(spark, sf_dir):
    return threads.threads(_dump(spark, sf_dir)).select("capture_id", "thread_name", "jvm_id", "daemon", "prio", F.col("cpu_ms").cast("long").alias("cpu_ms"), F.round("elapsed_s").cast("long").alias("elapsed_s"), "java_state", F.size("frames").alias("n_frames"), "top_frame")


@query("t15_snapshot_times", _DAY + " SELECT DISTINCT capture_id, CAST(0 AS BIGINT) AS snapshot_index, capture_id || ' 00:00:00' AS timestamp_raw, epoch_ms(CAST(capture_id AS TIMESTAMP)) AS epoch_ms, 'first' AS ordering_status FROM t")
def t15_snapshot_times(spark, sf_dir):
    return threads.snapshot_times(_dump(spark, sf_dir)).select("capture_id", F.col("snapshot_index").cast("long").alias("snapshot_index"), "timestamp_raw", "epoch_ms", "ordering_status")


@query("t7_lock_observations", _DAY + " SELECT capture_id, '0x' || lower(printf('%x', lock)) AS lock_id, 'monitor-enter' AS kind, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT capture_id, '0x' || lower(printf('%x', user_id)), 'monitor', count(*) FROM h GROUP BY ALL")
def t7_lock_observations(spark, sf_dir):
    return threads.lock_observations(_dump(spark, sf_dir)).groupBy("capture_id", "lock_id", "kind").agg(F.count("*").alias("n"))


@query("a1_state_census", _DAY + " SELECT capture_id, java_state, count(*) AS threads FROM t2 GROUP BY ALL")
def a1_state_census(spark, sf_dir):
    return threads.census(threads.threads(_dump(spark, sf_dir)))


@query("a2_kpi", _DAY + " SELECT capture_id, count(*) FILTER (WHERE java_state = 'RUNNABLE') AS runnable, count(*) FILTER (WHERE java_state = 'BLOCKED') AS blocked, count(*) FILTER (WHERE java_state LIKE '%WAITING') AS waiting, count(*) FILTER (WHERE user_id % 4 = 0) AS daemon FROM t2 GROUP BY 1")
def a2_kpi(spark, sf_dir):
    s = F.col("java_state")
    return threads.threads(_dump(spark, sf_dir)).groupBy("capture_id").agg(F.count_if(s == "RUNNABLE").alias("runnable"), F.count_if(s == "BLOCKED").alias("blocked"), F.count_if(s.endswith("WAITING")).alias("waiting"), F.count_if("daemon").alias("daemon"))


@query("a3_histogram", _DAY + " SELECT CASE WHEN cpu < 1000 THEN 0 WHEN cpu < 10000 THEN 1 WHEN cpu < 100000 THEN 2 ELSE 3 END AS bucket, count(*) AS n FROM t GROUP BY 1")
def a3_histogram(spark, sf_dir):
    return generic.histogram(threads.threads(_dump(spark, sf_dir)), "cpu_ms", [1000, 10000, 100000])


@query("a24_stack_groups", _DAY + " SELECT capture_id, java_state, 'at app.Handler' || m % 7 || '.run(Handler.java) < at app.Main.loop(Main.java)' AS stack, count(*) AS threads FROM t2 GROUP BY ALL")
def a24_stack_groups(spark, sf_dir):
    return threads.stack_groups(threads.threads(_dump(spark, sf_dir)))


@query("p1_thread_filter", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name FROM t2 WHERE user_id % 4 = 0 AND java_state IN ('BLOCKED', 'WAITING', 'TIMED_WAITING')")
def p1_thread_filter(spark, sf_dir):
    return threads.threads(_dump(spark, sf_dir)).where("daemon AND java_state IN ('BLOCKED', 'WAITING', 'TIMED_WAITING')").select("capture_id", "thread_name")


@query("p2_thread_search", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name FROM t2 WHERE m % 7 = 3")
def p2_thread_search(spark, sf_dir):
    return threads.threads(_dump(spark, sf_dir)).where(F.exists(F.array_append("frames", F.col("thread_name")), lambda x: F.contains(F.lower(x), F.lit("handler3.run")))).select("capture_id", "thread_name")


@query("j1_lock_owner_waiter", _DAY + " SELECT w.capture_id, CASE WHEN h.user_id IS NULL THEN 'owner-not-observed' ELSE 'unique-observed-owner' END AS resolution, count(*) AS n FROM w LEFT JOIN h ON h.capture_id = w.capture_id AND h.user_id = w.lock GROUP BY ALL")
def j1_lock_owner_waiter(spark, sf_dir):
    return threads.relations(threads.lock_observations(_dump(spark, sf_dir))).groupBy("capture_id", "resolution").agg(F.count("*").alias("n"))


@query("j2_contention_chains", _DAY + " SELECT w.capture_id, '0x' || lower(printf('%x', w.lock)) AS lock_id, count(DISTINCT h.user_id) AS owners, count(DISTINCT w.waiter) AS waiters FROM w LEFT JOIN h ON h.capture_id = w.capture_id AND h.user_id = w.lock GROUP BY ALL")
def j2_contention_chains(spark, sf_dir):
    return threads.contention(threads.lock_observations(_dump(spark, sf_dir))).select("capture_id", "lock_id", "owners", "waiters")


@query("a11_lock_severity", _DAY + ", b AS (SELECT h.capture_id, h.user_id, count(DISTINCT w.waiter) AS k FROM h JOIN w ON h.capture_id = w.capture_id AND h.user_id = w.lock GROUP BY ALL) SELECT t.capture_id, 'user-' || t.user_id AS thread_name, CASE WHEN t.kind = 'error' THEN 'contention' WHEN b.k > 0 THEN 'likely-blocker' ELSE 'confirmed-hold' END AS tier, CAST(CASE WHEN t.kind = 'error' THEN 60 WHEN b.k > 0 THEN least(55, 30 + 10 * b.k) ELSE 10 END AS INTEGER) AS score FROM t LEFT JOIN b USING (capture_id, user_id)")
def a11_lock_severity(spark, sf_dir):
    d = _dump(spark, sf_dir)
    return threads.severity(threads.threads(d), threads.lock_observations(d)).select("capture_id", "thread_name", "tier", "score")


def _counters(spark, sf_dir):
    t = threads.threads(_dump(spark, sf_dir))
    return t.select(F.col("thread_name").alias("series"), F.to_date("capture_id").alias("day"), F.col("cpu_ms").cast("long").alias("cpu"))


@query("w2_counter_delta", _DAY + ", d AS (SELECT 'user-' || user_id AS series, CAST(capture_id AS DATE) AS day, CAST(cpu AS BIGINT) AS cpu, lag(cpu) OVER (PARTITION BY user_id ORDER BY capture_id) AS b FROM t) SELECT series, day, cpu, CASE WHEN b IS NULL THEN 'baseline' WHEN cpu < b THEN 'reset' ELSE 'computed' END AS status, CASE WHEN cpu >= b THEN CAST(cpu - b AS BIGINT) END AS delta FROM d")
def w2_counter_delta(spark, sf_dir):
    return threads.counter_deltas(_counters(spark, sf_dir), "series", "day", "cpu")


@query("w8_longest_run", _DAY + ", d AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(capture_id AS DATE)) AS i FROM t), z AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM d), c AS (SELECT user_id, count(*) AS n FROM z GROUP BY user_id, k) SELECT 'user-' || user_id AS series, max(n) AS longest_run FROM c GROUP BY user_id")
def w8_longest_run(spark, sf_dir):
    return threads.runs(_counters(spark, sf_dir).withColumn("i", F.date_diff("day", F.lit("2024-01-01").cast("date"))), "series", "i")


@query("k4_union_of_tops", _DAY + ", r AS (SELECT capture_id, user_id, row_number() OVER (PARTITION BY capture_id ORDER BY cpu DESC, 'user-' || user_id) AS a, row_number() OVER (PARTITION BY capture_id ORDER BY m DESC, 'user-' || user_id) AS b FROM t) SELECT capture_id, 'user-' || user_id AS thread_name FROM r WHERE a <= 20 OR b <= 20")
def k4_union_of_tops(spark, sf_dir):
    return generic.union_of_tops(threads.threads(_dump(spark, sf_dir)), "capture_id", "thread_name", "cpu_ms", "elapsed_s", 20).select("capture_id", "thread_name")


@query("k5_priority_top", _DAY + ", r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY cpu DESC, 'user-' || user_id) AS k FROM t2) SELECT capture_id, 'user-' || user_id AS thread_name, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 10 OR java_state = 'BLOCKED'")
def k5_priority_top(spark, sf_dir):
    return generic.top_with_mandatory(threads.threads(_dump(spark, sf_dir)), "capture_id", [F.desc("cpu_ms"), "thread_name"], 10, F.col("java_state") == "BLOCKED").select("capture_id", "thread_name", "rank")


def _edges(spark, sf_dir):
    """waiter -> holder of the lock, over all days; ids are the users'."""
    _checkpoints(spark)
    d = _dump(spark, sf_dir)
    names = generic.cut(threads.threads(d).select("capture_id", "start_line", F.substring_index("thread_name", "-", -1).cast("long").alias("user_id")))
    rel = threads.relations(generic.cut(threads.lock_observations(d))).where("owner IS NOT NULL")
    a, b = names.withColumnsRenamed({"start_line": "waiter", "user_id": "source"}), names.withColumnsRenamed({"start_line": "owner", "user_id": "target"})
    return rel.join(a, ["capture_id", "waiter"]).join(b, ["capture_id", "owner"]).select("source", "target")


_EDGES = _DAY.replace("WITH ", "WITH RECURSIVE ", 1) + ", x AS (SELECT DISTINCT w.waiter AS source, w.lock AS target FROM w JOIN h ON h.capture_id = w.capture_id AND h.user_id = w.lock)"


@query("g2_dependency_edges", _EDGES + " SELECT source, target FROM x")
def g2_dependency_edges(spark, sf_dir):
    return _edges(spark, sf_dir).distinct()


@query("g7_dependents", _EDGES + ", p AS (SELECT source, target FROM x UNION SELECT p.source, x.target FROM p JOIN x ON p.target = x.source) SELECT target AS blocker, count(*) AS dependents FROM p GROUP BY 1")
def g7_dependents(spark, sf_dir):
    return generic.ancestor_counts(_edges(spark, sf_dir), own=True).where("n > 0").select(F.col("node").alias("blocker"), F.col("n").alias("dependents"))


@query("g4_depth", _EDGES + ", p AS (SELECT source, target, 1 AS d FROM x WHERE source <> target UNION ALL SELECT p.source, x.target, p.d + 1 FROM p JOIN x ON p.target = x.source WHERE x.source <> x.target), n AS (SELECT source AS node FROM x WHERE source <> target UNION SELECT target FROM x WHERE source <> target) SELECT node, coalesce(max(d), 0) AS depth FROM n LEFT JOIN p ON p.source = node GROUP BY node")
def g4_depth(spark, sf_dir):
    return generic.depths(_edges(spark, sf_dir))


@query("g3_cycles", "WITH RECURSIVE x AS (SELECT DISTINCT o_custkey % 97 AS source, (o_custkey * 7 + 1) % 61 AS target FROM orders), p AS (SELECT source, target FROM x UNION SELECT p.source, x.target FROM p JOIN x ON p.target = x.source) SELECT source AS node FROM p WHERE source = target")
def g3_cycles(spark, sf_dir):
    _checkpoints(spark)
    o = _table(spark, sf_dir, "orders")
    return generic.in_cycles(o.select((F.col("o_custkey") % 97).alias("source"), ((F.col("o_custkey") * 7 + 1) % 61).alias("target")))


# --- dumps of a month as one session -------------------------------------------

_DAY_MS = 86_400_000
_SES = _DAY + ", d AS (SELECT left(capture_id, 7) AS session, capture_id, CAST(dense_rank() OVER (PARTITION BY left(capture_id, 7) ORDER BY capture_id) AS INTEGER) AS snapshot, user_id, CAST(m AS BIGINT) AS m, CAST(cpu AS BIGINT) AS cpu, kind, java_state FROM t2), k AS (SELECT b.*, a.m AS m0, a.cpu AS cpu0, a.kind AS kind0, a.java_state AS state0, (epoch_ms(CAST(b.capture_id AS TIMESTAMP)) - epoch_ms(CAST(a.capture_id AS TIMESTAMP))) AS gap FROM d b JOIN d a ON a.session = b.session AND a.user_id = b.user_id AND a.snapshot = b.snapshot - 1), l AS (SELECT * FROM k WHERE m >= m0), r AS (SELECT *, 'user-' || user_id AS thread_name, cpu - cpu0 AS delta, round((cpu - cpu0) * 100.0::DOUBLE / gap, 6) AS percent FROM l WHERE cpu >= cpu0), c AS (SELECT d.*, max(CASE WHEN l.user_id IS NULL THEN d.snapshot END) OVER (PARTITION BY d.session, d.user_id ORDER BY d.snapshot) AS first_snapshot FROM d LEFT JOIN l USING (session, snapshot, user_id))"


def _session_threads(spark, sf_dir):
    """Threads of all days in sessions of a month; written, since pairs, links and what follows read them many times."""
    read = generic.cut(threads.threads(_dump(spark, sf_dir)))
    rows = series.in_sessions(series.source_keys(read), F.substring("capture_id", 1, 7))
    return generic.cut(rows.withColumn("epoch_ms", F.unix_millis(F.to_timestamp("capture_id"))))


def _session(spark, sf_dir):
    """(threads of all days in sessions of a month, candidate pairs, links), each written once."""
    rows = _session_threads(spark, sf_dir)
    pairs = generic.cut(series.candidates(rows))
    return rows, pairs, generic.cut(series.links(pairs))


@query("t11_source_keys", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name, '0x' || lower(printf('%x', user_id + 4096)) AS source_key FROM t")
def t11_source_keys(spark, sf_dir):
    return series.source_keys(threads.threads(_dump(spark, sf_dir))).select("capture_id", "thread_name", "source_key")


@query("t13_session_snapshots", _SES + " SELECT session, capture_id, snapshot, count(*) AS threads FROM d GROUP BY ALL")
def t13_session_snapshots(spark, sf_dir):
    return _session_threads(spark, sf_dir).groupBy("session", "capture_id", "snapshot").agg(F.count("*").alias("threads"))


@query("j7_identity_links", _SES + " SELECT session, snapshot, 'user-' || user_id AS thread_name FROM l")
def j7_identity_links(spark, sf_dir):
    rows, _, links = _session(spark, sf_dir)
    return rows.join(links, ["session", "snapshot", "source_key"]).select("session", "snapshot", "thread_name")


def _series(spark, sf_dir):
    _checkpoints(spark)
    rows, _, links = _session(spark, sf_dir)
    return series.series(rows, links), links


@query("j8_series", _SES + " SELECT session, snapshot, 'user-' || user_id AS thread_name, first_snapshot FROM c")
def j8_series(spark, sf_dir):
    return _series(spark, sf_dir)[0].select("session", "snapshot", "thread_name", "first_snapshot")


@query(
    "j10_change_counts",
    _SES + ", n AS (SELECT d.session, d.snapshot, count(*) FILTER (WHERE d.snapshot = 1) AS baseline, count(*) FILTER (WHERE k.m >= k.m0) AS continued, count(*) FILTER (WHERE k.m < k.m0) AS unresolved, count(*) FILTER (WHERE d.snapshot > 1 AND k.user_id IS NULL) AS new FROM d LEFT JOIN k USING (session, snapshot, user_id) GROUP BY ALL), g AS (SELECT d.session, d.snapshot + 1 AS snapshot, count(*) FILTER (WHERE l.user_id IS NULL) AS gone FROM d LEFT JOIN l ON l.session = d.session AND l.user_id = d.user_id AND l.snapshot = d.snapshot + 1 GROUP BY ALL) SELECT n.*, CASE WHEN snapshot > 1 AND unresolved = 0 THEN coalesce(gone, 0) END AS ended FROM n LEFT JOIN g USING (session, snapshot)",
)
def j10_change_counts(spark, sf_dir):
    return series.change_counts(*_session(spark, sf_dir))


@query(
    "j11_material_changes",
    _SES + ", f AS (SELECT session, snapshot, unnest([CASE WHEN java_state <> state0 THEN 'state' END, CASE WHEN m % 7 <> m0 % 7 THEN 'top-frame' END, CASE WHEN (kind = 'error') <> (kind0 = 'error') THEN 'waiting-locks' END, CASE WHEN user_id = 0 AND (kind = 'error') <> (kind0 = 'error') THEN 'held-locks' END, CASE WHEN cpu - cpu0 >= 20000 THEN 'cpu-activity' END]) AS change FROM l) SELECT session, snapshot, change, count(*) AS n FROM f WHERE change IS NOT NULL GROUP BY ALL",
)
def j11_material_changes(spark, sf_dir):
    rows, _, links = _session(spark, sf_dir)
    keys = ["capture_id", "snapshot_index", "start_line"]
    ids = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("lock_id"))))
    locks = threads.lock_observations(_dump(spark, sf_dir)).groupBy(*keys).agg(ids(threads.CONTENDED).alias("waiting_locks"), ids(threads.HOLDS).alias("held_locks"))
    full = rows.join(locks, keys, "left").withColumn("top_method", F.try_element_at(threads.normalize_frames("frames"), F.lit(1)))
    return series.material_changes(full, links, 20_000).groupBy("session", "snapshot", "change").agg(F.count("*").alias("n"))


def _rates(spark, sf_dir):
    rows, _, links = _session(spark, sf_dir)
    return series.cpu_rates(rows, links)


@query("w4_series_totals", _SES + " SELECT session, thread_name, CAST(sum(delta) AS BIGINT) AS delta_ms, CAST(sum(gap) AS BIGINT) AS interval_ms, count(*) AS samples, round(sum(delta) * 100.0::DOUBLE / sum(gap), 6) AS percent FROM r GROUP BY ALL")
def w4_series_totals(spark, sf_dir):
    return series.series_totals(_rates(spark, sf_dir), "session", "thread_name").withColumn("delta_ms", F.col("delta_ms").cast("long"))


@query("w5_busiest_threads", _SES + ", b AS (SELECT session, thread_name, max(percent) AS highest, avg(percent) AS mean FROM r GROUP BY ALL) SELECT session, thread_name, CAST(row_number() OVER (PARTITION BY session ORDER BY highest DESC, mean DESC, thread_name) AS INTEGER) AS rank, highest FROM b QUALIFY rank <= 10")
def w5_busiest_threads(spark, sf_dir):
    return series.busiest(_rates(spark, sf_dir), "thread_name", 10).select("session", "thread_name", "rank", "highest")


@query(
    "w5_timeline_points",
    _SES + ", x AS (SELECT r.*, c.first_snapshot FROM r JOIN c USING (session, snapshot, user_id)), b AS (SELECT session, user_id, first_snapshot, max(percent) AS highest, round(avg(percent), 6) AS mean, count(*) AS samples FROM x GROUP BY ALL), v AS (SELECT *, count(*) OVER (PARTITION BY session) AS available, CAST(row_number() OVER (PARTITION BY session ORDER BY highest DESC, mean DESC, 'user-' || user_id, first_snapshot) AS INTEGER) AS rank FROM b QUALIFY rank <= 10) "
    "SELECT session, rank, available, thread_name, first_snapshot, samples, highest, mean, snapshot, percent, CAST(delta AS BIGINT) AS delta_ms, CAST(gap AS BIGINT) AS interval_ms, java_state FROM x JOIN v USING (session, user_id, first_snapshot)",
)
def w5_timeline_points(spark, sf_dir):
    rows, links = _series(spark, sf_dir)
    rates = series.cpu_rates(rows, links).select("session", "first_snapshot", "first_key", "snapshot", "thread_name", "percent", "delta_ms", "interval_ms", "java_state")
    points = series.cpu_timeline(generic.cut(rates), 10)
    return points.select("session", "rank", "available", "thread_name", "first_snapshot", "samples", "highest", "mean", "snapshot", "percent", F.col("delta_ms").cast("long").alias("delta_ms"), "interval_ms", "java_state")


@query("a29_interval_summary", _SES + ", x AS (SELECT session, snapshot, max(delta) AS peak_ms, count(*) FILTER (WHERE delta >= 20000) AS hot FROM r GROUP BY ALL) SELECT x.session, x.snapshot, CAST(peak_ms AS BIGINT) AS peak_ms, hot, min(thread_name) AS peak FROM x JOIN r ON r.session = x.session AND r.snapshot = x.snapshot AND r.delta = x.peak_ms GROUP BY ALL")
def a29_interval_summary(spark, sf_dir):
    return series.interval_summary(_rates(spark, sf_dir), "thread_name", 20_000).withColumn("peak_ms", F.col("peak_ms").cast("long"))


@query("a26_cpu_coverage", _SES + " SELECT session, snapshot, count(*) AS threads, count(r.user_id) AS covered, round(count(r.user_id) * 1.0::DOUBLE / count(*), 6) AS coverage FROM d LEFT JOIN (SELECT session, snapshot, user_id FROM r) r USING (session, snapshot, user_id) GROUP BY ALL")
def a26_cpu_coverage(spark, sf_dir):
    rows, _, links = _session(spark, sf_dir)
    known = series.cpu_rates(rows, links).select("session", "snapshot", "source_key", F.lit(1).alias("known"))
    per = rows.join(known, ["session", "snapshot", "source_key"], "left").groupBy("session", "snapshot").agg(F.count("*").alias("threads"), F.count("known").alias("covered"))
    return per.withColumn("coverage", F.round(F.col("covered") / F.col("threads"), 6))


_RUNS = ", p AS (SELECT session, user_id, first_snapshot, snapshot, CAST(kind = 'error' AS INTEGER) AS on_, coalesce(CAST(kind = 'error' AS INTEGER) <> lag(CAST(kind = 'error' AS INTEGER)) OVER w, FALSE) AS ch FROM c WINDOW w AS (PARTITION BY session, user_id, first_snapshot ORDER BY snapshot)), q AS (SELECT *, sum(CAST(ch AS INTEGER)) OVER (PARTITION BY session, user_id, first_snapshot ORDER BY snapshot) AS run FROM p), z AS (SELECT session, user_id, first_snapshot, run, count(*) AS n, max(on_) AS on_ FROM q GROUP BY ALL)"


@query("w6_blocked_trend", _SES + _RUNS + " SELECT session, '0x' || lower(printf('%x', user_id + 4096)) AS first_key, first_snapshot, CAST(sum(n) AS BIGINT) AS snapshots, CAST(sum(n * on_) AS BIGINT) AS present, CAST(max(run) AS BIGINT) AS transitions, max(n * on_) AS longest, arg_max(n * on_, run) AS current FROM z GROUP BY ALL")
def w6_blocked_trend(spark, sf_dir):
    return series.presence_trend(_series(spark, sf_dir)[0], F.col("java_state") == "BLOCKED", "session", "first_snapshot", "first_key")


_SERIES = "session, user_id, first_snapshot"


@query(
    "w6_diagnostic_trends",
    _SES + f", o AS (SELECT c.*, row_number() OVER (PARTITION BY {_SERIES} ORDER BY snapshot) AS place, count(*) OVER (PARTITION BY {_SERIES}) AS total FROM c), u AS (SELECT DISTINCT {_SERIES}, diagnostic FROM (SELECT {_SERIES}, unnest([java_state, CASE WHEN cpu >= 20000 THEN 'busy' END]) AS diagnostic FROM o) WHERE diagnostic IS NOT NULL), "
    f"v AS (SELECT {_SERIES}, snapshot, place, total, diagnostic, (java_state = diagnostic OR (diagnostic = 'busy' AND cpu >= 20000)) AS x FROM o JOIN u USING ({_SERIES})), y AS (SELECT *, coalesce(x <> lag(x) OVER (PARTITION BY {_SERIES}, diagnostic ORDER BY place), FALSE) AS ch FROM v), z AS (SELECT *, sum(CAST(ch AS INTEGER)) OVER (PARTITION BY {_SERIES}, diagnostic ORDER BY place) AS run FROM y), "
    f"n AS (SELECT {_SERIES}, diagnostic, total, run, x, count(*) AS n, min(snapshot) AS a, max(snapshot) AS b FROM z GROUP BY ALL), f AS (SELECT {_SERIES}, diagnostic, total, CAST(sum(n) FILTER (WHERE x) AS BIGINT) AS present, CAST(max(run) AS BIGINT) AS transitions, max(n) FILTER (WHERE x) AS longest, CASE WHEN arg_max(x, run) THEN arg_max(n, run) ELSE 0 END AS current, arg_min(x, run) AS x0, arg_max(x, run) AS x1, min(a) FILTER (WHERE x) AS first_observed, max(b) FILTER (WHERE x) AS last_observed FROM n GROUP BY ALL), "
    "g AS (SELECT f.*, CASE WHEN k.m < k.m0 THEN 'identity-unavailable' WHEN total < 2 THEN 'insufficient-data' ELSE 'available' END AS status FROM f LEFT JOIN k ON k.session = f.session AND k.user_id = f.user_id AND k.snapshot = f.first_snapshot) "
    "SELECT session, first_snapshot, '0x' || lower(printf('%x', user_id + 4096)) AS first_key, diagnostic, total, status, present, transitions, longest, current, first_observed, last_observed, CASE WHEN status <> 'available' THEN 'insufficient-data' WHEN NOT x0 AND x1 THEN 'growing' WHEN x0 AND NOT x1 THEN 'shrinking' ELSE 'stable' END AS trend FROM g",
)
def w6_diagnostic_trends(spark, sf_dir):
    """Trends of thread states and of 20 seconds of CPU or more."""
    _checkpoints(spark)
    rows, pairs, links = _session(spark, sf_dir)
    placed = generic.cut(series.continuity(series.series(rows, links), pairs, links))
    met = placed.select("session", "snapshot", "source_key", F.explode(F.array_compact(F.array("java_state", F.when(F.col("cpu_ms") >= 20_000, "busy")))).alias("diagnostic"))
    return series.diagnostic_trends(placed, met)


@query("a13_snapshot_deltas", _SES + ", n AS (SELECT session, snapshot, count(*) AS threads, count(*) FILTER (WHERE java_state = 'BLOCKED') AS blocked, count(*) FILTER (WHERE java_state = 'RUNNABLE') AS runnable, count(*) FILTER (WHERE java_state LIKE '%WAITING') AS waiting FROM d GROUP BY ALL) SELECT *, threads - lag(threads) OVER w AS threads_delta, blocked - lag(blocked) OVER w AS blocked_delta, runnable - lag(runnable) OVER w AS runnable_delta, waiting - lag(waiting) OVER w AS waiting_delta FROM n WINDOW w AS (PARTITION BY session ORDER BY snapshot)")
def a13_snapshot_deltas(spark, sf_dir):
    return series.snapshot_deltas(_session_threads(spark, sf_dir))


@query("w13_spaced_snapshots", _SES + ", n AS (SELECT session, max(snapshot) AS size FROM d GROUP BY 1) SELECT DISTINCT session, CAST(CASE WHEN size <= 7 THEN i ELSE round(i * (size - 1) / 6.0::DOUBLE) END AS INTEGER) AS snapshot FROM n, range(7) g(i) WHERE i < size")
def w13_spaced_snapshots(spark, sf_dir):
    places = _session_threads(spark, sf_dir).select("session", (F.col("snapshot") - 1).alias("snapshot"))
    return series.evenly_spaced(places, "session", "snapshot", 7)


# --- lines, stacks and locks of one dump ---------------------------------------


@query("p7_line_kinds", _DAY + ", x AS (SELECT capture_id, count(*) AS n, count(*) FILTER (WHERE kind = 'error') AS b FROM t GROUP BY 1) SELECT capture_id, unnest(['header', 'state', 'frame', 'lock', 'empty', 'detail']) AS kind, unnest([n, n, 2 * n, n + b, n + 1, 2]) AS n FROM x")
def p7_line_kinds(spark, sf_dir):
    return _dump(spark, sf_dir).groupBy("capture_id", threads.line_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("p4_source_search", _DAY + " SELECT capture_id, o AS \"offset\", count(*) AS n FROM t, (VALUES (8), (21)) v(o) GROUP BY ALL")
def p4_source_search(spark, sf_dir):
    return generic.find_literal(_dump(spark, sf_dir), "text", "hANDLER").groupBy("capture_id", "offset").agg(F.count("*").alias("n"))


@query("p10_stack_highlights", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name, 'at app.Handler' || m % 7 || '.run(Handler.java:' || user_id || ') < at app.Main.loop(Main.java:5)' AS highlights, 'outside-jdk-packages' AS selection FROM t")
def p10_stack_highlights(spark, sf_dir):
    shown, selection = threads.highlights(F.col("frames"))
    return threads.threads(_dump(spark, sf_dir)).select("capture_id", "thread_name", F.array_join(shown, " < ").alias("highlights"), selection.alias("selection"))


_LOCKS = ", i AS (SELECT capture_id, lock, waiter, NULL AS owner FROM w UNION ALL SELECT capture_id, user_id, NULL, user_id FROM h), x AS (SELECT capture_id, lock, count(*) AS occurrences, count(DISTINCT owner) AS owners, count(DISTINCT waiter) AS contended FROM i GROUP BY ALL)"


@query("a4_lock_index", _DAY + _LOCKS + " SELECT capture_id, '0x' || lower(printf('%x', lock)) AS lock_id, occurrences, owners, contended, CAST(0 AS BIGINT) AS notified, contended > 0 AND owners = 0 AS unresolved, 'monitor' AS category FROM x")
def a4_lock_index(spark, sf_dir):
    return threads.lock_index(threads.lock_observations(_dump(spark, sf_dir))).drop("snapshot_index")


_ROLES = ", o AS (SELECT t.capture_id, t.user_id, t.java_state, w.waiter IS NOT NULL AS waits, h.user_id IS NOT NULL AS holds, w.lock FROM t2 t LEFT JOIN w ON w.capture_id = t.capture_id AND w.waiter = t.user_id LEFT JOIN h ON h.capture_id = t.capture_id AND h.user_id = t.user_id)"


@query("g6_lock_roles", _DAY + _ROLES + " SELECT capture_id, count(*) FILTER (WHERE waits) AS monitor_waiters, count(*) FILTER (WHERE holds) AS monitor_holders, count(*) FILTER (WHERE waits AND holds) AS both FROM o GROUP BY 1")
def g6_lock_roles(spark, sf_dir):
    roles = threads.lock_roles(threads.lock_observations(_dump(spark, sf_dir)))
    return roles.groupBy("capture_id").agg(F.count_if("monitor_waiter").alias("monitor_waiters"), F.count_if("monitor_holder").alias("monitor_holders"), F.count_if(F.col("monitor_waiter") & F.col("monitor_holder")).alias("both"))


@query("a5_evidence_counts", _DAY + _ROLES + " SELECT o.capture_id, count(*) FILTER (WHERE java_state = 'BLOCKED') AS blocked, count(*) FILTER (WHERE java_state = 'WAITING') AS waiting, count(*) FILTER (WHERE java_state = 'TIMED_WAITING') AS timed, count(*) FILTER (WHERE waits) AS contended, count(*) FILTER (WHERE holds) AS owners, count(*) FILTER (WHERE waits AND holds) AS holding_and_waiting, count(*) FILTER (WHERE waits AND h.user_id IS NULL) AS unresolved FROM o LEFT JOIN h ON h.capture_id = o.capture_id AND h.user_id = o.lock GROUP BY 1")
def a5_evidence_counts(spark, sf_dir):
    d = _dump(spark, sf_dir)
    return threads.evidence_counts(threads.threads(d), threads.lock_observations(d)).drop("snapshot_index")


@query("g5_node_roles", _DAY + _ROLES + ", edge AS (SELECT w.capture_id, w.waiter, h.user_id AS owner FROM w JOIN h ON h.capture_id = w.capture_id AND h.user_id = w.lock) SELECT o.capture_id, 'user-' || o.user_id AS thread_name, (SELECT count(*) FROM edge e WHERE e.capture_id = o.capture_id AND e.waiter = o.user_id) AS depends, (SELECT count(*) FROM edge e WHERE e.capture_id = o.capture_id AND e.owner = o.user_id) AS blocks, CASE WHEN waits AND holds THEN 'waiter-owner' WHEN waits THEN 'waiter' ELSE 'owner' END AS role FROM o")
def g5_node_roles(spark, sf_dir):
    d = _dump(spark, sf_dir)
    return threads.degrees(threads.threads(d), threads.lock_observations(d)).drop("snapshot_index", "start_line")


@query("k6_top_locks", _DAY + ", x AS (SELECT capture_id, '0x' || lower(printf('%x', lock)) AS lock_id, count(*) AS waiters FROM w GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY waiters DESC, lock_id) AS INTEGER) AS rank, greatest(0, waiters - 1) AS hidden FROM x QUALIFY rank <= 5")
def k6_top_locks(spark, sf_dir):
    return threads.top_locks(threads.lock_observations(_dump(spark, sf_dir)), 5, 1).drop("snapshot_index")


# --- handshake logs ----------------------------------------------------------


@query("l1_tls_records", _TLS + " SELECT capture_id, tid, ms AS epoch_ms, 3 AS line_count, count(*) AS n FROM r GROUP BY ALL")
def l1_tls_records(spark, sf_dir):
    return _tls_records(spark, sf_dir).groupBy("capture_id", "tid", "epoch_ms", "line_count").agg(F.count("*").alias("n"))


@query("l3_tls_interactions", _TLS + " SELECT * FROM i")
def l3_tls_interactions(spark, sf_dir):
    return _tls(spark, sf_dir).select("capture_id", "tid", "interaction", "start_ms", "end_ms", "records", "outcome")


@query("a19_tls_outcomes", _TLS + " SELECT outcome, count(*) AS interactions FROM i GROUP BY 1")
def a19_tls_outcomes(spark, sf_dir):
    return tls.census(_tls(spark, sf_dir))


@query("a20_tls_facets", _TLS + " SELECT capture_id, count(*) FILTER (WHERE outcome = 'success') AS n FROM i GROUP BY 1")
def a20_tls_facets(spark, sf_dir):
    return tls.facet(_tls(spark, sf_dir), "capture_id", F.col("outcome") == "success")


_JAN = (BASE_US // 1000, BASE_US // 1000 + 31 * 86_400_000)


@query("a21_tls_timeline", _TLS + f", b AS (SELECT least(63, floor((start_ms - {_JAN[0]}) / ({_JAN[1] - _JAN[0]}) * 64)) AS bin, outcome FROM i WHERE start_ms >= {_JAN[0]} AND start_ms < {_JAN[1]}) SELECT CAST(k AS INTEGER) AS bin, count(outcome) FILTER (WHERE outcome = 'success') AS success, count(outcome) FILTER (WHERE outcome = 'failure') AS failure, count(outcome) AS total FROM range(64) q(k) LEFT JOIN b ON b.bin = k GROUP BY k")
def a21_tls_timeline(spark, sf_dir):
    return tls.bins(_tls(spark, sf_dir), *_JAN, 64)


@query("a23_tls_time_domain", _TLS + " SELECT min(start_ms) AS start_ms, greatest(min(start_ms) + 1, max(end_ms) + 1) AS end_ms FROM i")
def a23_tls_time_domain(spark, sf_dir):
    return _tls(spark, sf_dir).agg(F.min("start_ms").alias("start_ms"), F.greatest(F.min("start_ms") + 1, F.max("end_ms") + 1).alias("end_ms"))


@query("p5_tls_period", _TLS + f" SELECT capture_id, tid, interaction FROM i WHERE start_ms < {_JAN[0] + 864_000_000} AND end_ms >= {_JAN[0] + 432_000_000}")
def p5_tls_period(spark, sf_dir):
    return tls.overlapping(_tls(spark, sf_dir), _JAN[0] + 432_000_000, _JAN[0] + 864_000_000).select("capture_id", "tid", "interaction")


# --- any table ---------------------------------------------------------------


@query("j13_as_of", "SELECT c.c_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) AS o_orderstatus FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o_orderdate <= DATE '1996-06-30' GROUP BY 1")
def j13_as_of(spark, sf_dir):
    wanted = _table(spark, sf_dir, "customer").select("c_custkey", F.lit("1996-06-30").cast("date").alias("at"))
    states = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderstatus")
    return generic.as_of(states, wanted, "c_custkey", "o_orderdate", "at", "o_orderstatus").select("c_custkey", "o_orderstatus")


@query("j14_version_diff", "WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) FILTER (WHERE o_orderdate <= DATE '1995-01-01') AS before, arg_max(o_orderstatus, (o_orderdate, o_orderstatus)) FILTER (WHERE o_orderdate <= DATE '1997-01-01') AS after FROM orders GROUP BY 1) SELECT * FROM s WHERE before IS DISTINCT FROM after")
def j14_version_diff(spark, sf_dir):
    at = lambda d: F.lit(d).cast("date")
    return generic.changed_between(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderstatus", at("1995-01-01"), at("1997-01-01"))


@query("j17_completeness", "SELECT r_name, n_name, coalesce(k, 0) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def j17_completeness(spark, sf_dir):
    plan = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    had = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("k"))
    return plan.join(had, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", F.coalesce("k", F.lit(0)).alias("customers"))


@query("k3_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def k3_page(spark, sf_dir):
    return generic.page(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100, 50)


@query("x1_search", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents) SELECT doc_id, count(*) AS score FROM w WHERE word IN ('license', 'licensed') GROUP BY 1 HAVING count(DISTINCT word) = 2")
def x1_search(spark, sf_dir):
    return generic.search(_table(spark, sf_dir, "documents"), "license licensed")


@query("u2_distinct_last", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def u2_distinct_last(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("u3_both_differences", "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1993-01-01'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01') SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'gone' WHEN a.o_custkey IS NULL THEN 'appeared' ELSE 'both' END AS side FROM a FULL JOIN b ON a.o_custkey = b.o_custkey")
def u3_both_differences(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return generic.set_sides(o.where("o_orderdate < DATE '1993-01-01'"), o.where("o_orderdate >= DATE '1998-01-01'"), "o_custkey")


@query("u3_set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1996-01-01' EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1996-01-01'")
def u3_set_difference(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.where("o_orderdate < DATE '1996-01-01'").select("o_custkey").distinct().join(o.where("o_orderdate >= DATE '1996-01-01'"), "o_custkey", "left_anti")
