"""Queries of snapshots, thread blocks, class initialization, deadlocks, evidence and blocking patterns in thread dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import blocking, evidence, generic, ordering, patterns, series, threads
from capturelake.plans import rendered
from capturelake.plans.catalogue import _DAY, _E, _EDGES, _ROLES, _SES, _checkpoints, _dump, _session, _table, query

_PAIRS = ", z AS (SELECT a.capture_id, a.user_id FROM t a JOIN t b ON b.capture_id = a.capture_id AND b.user_id = a.user_id + 1 WHERE a.user_id % 10 = 0), y AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY user_id) AS cycle_id FROM z)"


def _trouble(spark, sf_dir, by="day"):
    return threads.snapshots(rendered.lines(rendered.trouble_dumps(_table(spark, sf_dir, "events"), by), rendered.USERS))


# --- snapshots of a capture ----------------------------------------------------


@query("t1_snapshots", _DAY + " SELECT left(capture_id, 7) AS capture_id, CAST(dense_rank() OVER (PARTITION BY left(capture_id, 7) ORDER BY capture_id) - 1 AS INTEGER) AS snapshot_index, threads FROM (SELECT capture_id, count(*) AS threads FROM t GROUP BY 1)")
def t1_snapshots(spark, sf_dir):
    return threads.threads(_trouble(spark, sf_dir, "month")).groupBy("capture_id", F.col("snapshot_index").cast("int").alias("snapshot_index")).agg(F.count("*").alias("threads"))


@query("t15_ordered_snapshots", _DAY + ", d AS (SELECT DISTINCT capture_id AS day FROM t) SELECT left(day, 7) AS capture_id, epoch_ms(CAST(day AS TIMESTAMP)) AS epoch_ms, CASE WHEN lag(day) OVER w IS NULL THEN 'first' ELSE 'ordered' END AS ordering_status, epoch_ms(CAST(day AS TIMESTAMP)) - epoch_ms(CAST(lag(day) OVER w AS TIMESTAMP)) AS gap_ms FROM d WINDOW w AS (PARTITION BY left(day, 7) ORDER BY day)")
def t15_ordered_snapshots(spark, sf_dir):
    return threads.snapshot_times(_trouble(spark, sf_dir, "month")).select("capture_id", "epoch_ms", "ordering_status", "gap_ms")


_SIZES = ", s AS (SELECT *, CASE kind WHEN 'error' THEN 2 WHEN 'click' THEN 3 ELSE 1 END + 4 AS size FROM t)"


@query("t2_thread_blocks", _DAY + _SIZES + " SELECT capture_id, 'user-' || user_id AS thread_name, size AS n_lines FROM s")
def t2_thread_blocks(spark, sf_dir):
    return threads.threads(_trouble(spark, sf_dir)).select("capture_id", "thread_name", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


@query("j18_source_lines", _DAY + _SIZES + " SELECT left(capture_id, 7) AS capture_id, 'user-' || user_id AS thread_name, CAST(dense_rank() OVER (PARTITION BY left(capture_id, 7) ORDER BY capture_id) - 1 AS INTEGER) AS snapshot_index, CAST(4 + coalesce(sum(size) OVER (PARTITION BY capture_id ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS local_line FROM s")
def j18_source_lines(spark, sf_dir):
    marked = _trouble(spark, sf_dir, "month")
    return threads.source_lines(marked, threads.threads(marked)).select("capture_id", "thread_name", F.col("snapshot_index").cast("int").alias("snapshot_index"), F.col("local_line").cast("int").alias("local_line"))


@query("t5_thread_states", _DAY + " SELECT capture_id, CASE kind WHEN 'click' THEN 'WAITING' WHEN 'purchase' THEN 'TIMED_WAITING' ELSE 'RUNNABLE' END AS java_state, count(*) AS n FROM t GROUP BY ALL")
def t5_thread_states(spark, sf_dir):
    return threads.threads(_trouble(spark, sf_dir)).groupBy("capture_id", "java_state").agg(F.count("*").alias("n"))


_FRAMES = ", f AS (SELECT capture_id, user_id, unnest(CASE kind WHEN 'error' THEN ['at app.Caller.call(Caller.java:1)'] WHEN 'signup' THEN ['at app.C' || user_id % 5 || '.<clinit>(C.java:1)'] WHEN 'click' THEN ['at jdk.internal.misc.Unsafe.park(java.base@21/Native Method)', 'at java.util.concurrent.CompletableFuture.get(java.base@21/CompletableFuture.java:1)', 'at jdk.internal.net.http.HttpClientImpl.send(java.net.http@21/HttpClientImpl.java:2)'] ELSE ['at app.Handler' || m % 7 || '.run(Handler.java:' || user_id || ')'] END || ['at app.Main.loop(Main.java:5)']) AS frame FROM t)"


@query("t6_stack_frames", _DAY + _FRAMES + " SELECT capture_id, 'user-' || user_id AS thread_name, frame FROM f")
def t6_stack_frames(spark, sf_dir):
    return threads.threads(_trouble(spark, sf_dir)).select("capture_id", "thread_name", F.explode("frames").alias("frame"))


@query("t16_normalized_frames", _DAY + _FRAMES + " SELECT capture_id, regexp_replace(frame, ':\\d+\\)', ')') AS frame, count(*) AS n FROM f GROUP BY ALL")
def t16_normalized_frames(spark, sf_dir):
    return threads.threads(_trouble(spark, sf_dir)).select("capture_id", F.explode(threads.normalize_frames("frames")).alias("frame")).groupBy("capture_id", "frame").agg(F.count("*").alias("n"))


@query("t18_runtime_facts", _DAY + " SELECT DISTINCT capture_id, 'OpenJDK 64-Bit Server VM' AS vm_name, '21.0.1+12' AS vm_version, 'mixed mode' AS vm_info FROM t")
def t18_runtime_facts(spark, sf_dir):
    return threads.runtime_info(_trouble(spark, sf_dir)).drop("snapshot_index")


@query("t12_parse_status", _DAY + " SELECT capture_id, CAST(0 AS BIGINT) AS unparsed, count(*) AS threads, 'success' AS status FROM t GROUP BY ALL")
def t12_parse_status(spark, sf_dir):
    return threads.parse_status(_trouble(spark, sf_dir)).select("capture_id", "unparsed", "threads", "status")


@query("t19_allocation_bounds", _DAY + ", b AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN user_id * 1048576.0::DOUBLE + 524288 ELSE user_id * 1024.0::DOUBLE END AS size, CASE WHEN user_id % 3 = 0 THEN 1048576.0::DOUBLE * 0.1 ELSE 1024.0::DOUBLE END AS step FROM t) SELECT capture_id, 'user-' || user_id AS thread_name, CAST(CASE WHEN user_id % 3 = 0 THEN greatest(0, floor(size - step)) ELSE size END AS BIGINT) AS minimum, CAST(ceil(size + step) - 1 AS BIGINT) AS maximum FROM b")
def t19_allocation_bounds(spark, sf_dir):
    marked = _trouble(spark, sf_dir)
    header = marked.select("capture_id", F.col("line_no").alias("start_line"), F.regexp_extract("text", r"\ballocated=(\S+)", 1).alias("printed"))
    t = threads.threads(marked).join(header, ["capture_id", "start_line"])
    return t.select("capture_id", "thread_name", threads.allocation_bounds(F.col("printed")).alias("b")).select("capture_id", "thread_name", "b.minimum", "b.maximum")


@query("t4_sizes", f"WITH {_E} SELECT event_id, (event_id % 1000 + 0.5::DOUBLE) * pow(1024.0::DOUBLE, event_id % 5) AS bytes FROM e")
def t4_sizes(spark, sf_dir):
    from capturelake.operators.gc import size_bytes

    number = F.col("event_id")
    printed = F.concat((number % 1000).cast("string"), F.lit(".5"))
    return _table(spark, sf_dir, "events").select("event_id", size_bytes(printed, F.element_at(F.array(*map(F.lit, ("", "K", "M", "G", "T"))), (number % 5).cast("int") + 1)).alias("bytes"))


@query("t14_timestamp_quality", f"WITH {_E} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' ELSE 'valid' END AS quality, CASE event_id % 5 WHEN 2 THEN 'utc' WHEN 3 THEN 'offset' WHEN 4 THEN 'unspecified' END AS timezone, CASE WHEN event_id % 5 > 1 THEN epoch_ms(date_trunc('second', ts)) + 7 - CASE WHEN event_id % 5 = 3 THEN 19800000 ELSE 0 END END AS epoch_ms FROM e")
def t14_timestamp_quality(spark, sf_dir):
    number = F.col("event_id") % 5
    clock = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    printed = F.when(number == 1, "2024-02-30 10:00:00").when(number == 2, F.concat(clock, F.lit(".007Z"))).when(number == 3, F.concat(clock, F.lit(",007 +05:30"))).when(number == 4, F.concat(clock, F.lit(".007")))
    return _table(spark, sf_dir, "events").select("event_id", threads.timestamp_quality(printed).alias("t")).select("event_id", "t.quality", "t.timezone", "t.epoch_ms")


# --- class initialization and deadlocks ------------------------------------------


def _classes(spark, sf_dir):
    return threads.class_initialization(_trouble(spark, sf_dir))


@query("t8_class_initialization", _DAY + " SELECT capture_id, 'app.C' || user_id % 5 AS class_name, CASE kind WHEN 'error' THEN 'class-initialization-wait' ELSE 'class-initializer' END AS kind, count(*) AS n FROM t WHERE kind IN ('error', 'signup') GROUP BY ALL")
def t8_class_initialization(spark, sf_dir):
    return _classes(spark, sf_dir).groupBy("capture_id", "class_name", "kind").agg(F.count("*").alias("n"))


@query("j4_class_chains", _DAY + ", c AS (SELECT capture_id, 'app.C' || user_id % 5 AS class_name, count(*) FILTER (WHERE kind = 'error') AS waiters, count(*) FILTER (WHERE kind = 'signup') AS initializers FROM t GROUP BY ALL) SELECT *, CASE WHEN initializers = 0 THEN 'initializer-not-observed' WHEN initializers > 1 THEN 'ambiguous-initializer' ELSE 'initializing' END AS status FROM c WHERE waiters > 0")
def j4_class_chains(spark, sf_dir):
    marked = _trouble(spark, sf_dir)
    return threads.class_chains(threads.class_initialization(marked), threads.threads(marked)).drop("snapshot_index")


@query("t10_deadlock_entries", _DAY + _PAIRS + " SELECT capture_id, CAST(cycle_id AS INTEGER) AS cycle_id, unnest([1, 2]) AS entry_no, 'user-' || unnest([user_id, user_id + 1]) AS thread_name, '0x' || lower(printf('%x', unnest([user_id + 7, user_id + 8]))) AS waiting_lock_id, 'user-' || unnest([user_id + 1, user_id]) AS held_by FROM y")
def t10_deadlock_entries(spark, sf_dir):
    return threads.deadlock_entries(_trouble(spark, sf_dir)).select("capture_id", "cycle_id", "entry_no", "thread_name", "waiting_lock_id", "held_by")


@query("a14_deadlock_summary", _DAY + _PAIRS + " SELECT capture_id, CAST(count(*) AS INTEGER) AS cycles, 2 * count(*) AS entries, 2 * count(*) AS matched_threads FROM y GROUP BY 1")
def a14_deadlock_summary(spark, sf_dir):
    marked = _trouble(spark, sf_dir)
    return threads.deadlock_summary(threads.deadlock_entries(marked), threads.threads(marked)).drop("snapshot_index")


def _annotated(spark, sf_dir):
    marked = _trouble(spark, sf_dir)
    people = series.source_keys(threads.threads(marked)).withColumn("waiting_locks", F.array().cast("array<string>"))
    return evidence.annotate_deadlocks(threads.deadlock_entries(marked), people)


@query("j6_deadlock_annotation", _DAY + _PAIRS + " SELECT capture_id, CAST(cycle_id AS INTEGER) AS cycle_id, '0x' || lower(printf('%x', unnest([user_id, user_id + 1]) + 4096)) AS waiter_key, '0x' || lower(printf('%x', unnest([user_id + 1, user_id]) + 4096)) AS holder_key, TRUE AS mapped FROM y")
def j6_deadlock_annotation(spark, sf_dir):
    return _annotated(spark, sf_dir).select("capture_id", "cycle_id", "waiter_key", "holder_key", "mapped")


@query("g9_closed_loops", _DAY + _PAIRS + " SELECT capture_id, CAST(cycle_id AS INTEGER) AS cycle_id, CAST(2 AS BIGINT) AS entries, TRUE AS closed FROM y")
def g9_closed_loops(spark, sf_dir):
    _checkpoints(spark)
    return threads.closed_loops(_annotated(spark, sf_dir)).select("capture_id", "cycle_id", "entries", "closed")


@query("p9_http_waits", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name FROM t WHERE kind = 'click'")
def p9_http_waits(spark, sf_dir):
    return threads.threads(_trouble(spark, sf_dir)).where(threads.waits_for_http(F.col("frames"), F.col("java_state"))).select("capture_id", "thread_name")


# --- evidence of a dump ----------------------------------------------------------

_EVIDENCE = _DAY + _ROLES + ", bw AS (SELECT h.capture_id, h.user_id, count(DISTINCT w.waiter) AS k FROM h JOIN w ON w.capture_id = h.capture_id AND w.lock = h.user_id GROUP BY ALL), ev AS (SELECT o.*, coalesce(k, 0) AS k, o.waits AND hh.user_id IS NULL AS lost FROM o LEFT JOIN bw USING (capture_id, user_id) LEFT JOIN h hh ON hh.capture_id = o.capture_id AND hh.user_id = o.lock)"


def _evidence(spark, sf_dir):
    d = _dump(spark, sf_dir)
    return threads.thread_evidence(threads.threads(d), threads.lock_observations(d))


_PREDICATES = {"everything": "TRUE", "problems": "waits OR k > 0", "contended": "waits OR k > 0", "blocked": "java_state = 'BLOCKED'", "holders": "holds", "holding-and-waiting": "waits AND holds", "monitor-enter": "waits", "monitor-holders": "holds", "unresolved": "lost"}


@query("p3_evidence_filters", _EVIDENCE + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT capture_id, '{name}' AS filter, count(*) AS n FROM ev WHERE {test} GROUP BY ALL" for name, test in _PREDICATES.items()) + ")")
def p3_evidence_filters(spark, sf_dir):
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in threads.block_filters().items()]))
    return _evidence(spark, sf_dir).select("capture_id", F.explode(named).alias("filter")).groupBy("capture_id", "filter").agg(F.count("*").alias("n"))


@query("p3_lock_neighbourhood", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name FROM (SELECT capture_id, waiter AS user_id FROM w WHERE lock = 7 UNION SELECT capture_id, user_id FROM h WHERE user_id = 7)")
def p3_lock_neighbourhood(spark, sf_dir):
    d = _dump(spark, sf_dir)
    near = threads.lock_neighbourhood(threads.lock_observations(d), "0X7")
    return threads.threads(d).join(near, ["capture_id", "snapshot_index", "start_line"], "left_semi").select("capture_id", "thread_name")


@query("k7_evidence_order", _EVIDENCE + ", pr AS (SELECT *, CASE WHEN java_state = 'BLOCKED' THEN 3 WHEN waits THEN 4 WHEN k > 0 THEN 5 ELSE 7 END AS priority FROM ev) SELECT capture_id, 'user-' || user_id AS thread_name, priority, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY priority, 'user-' || user_id) AS INTEGER) AS place FROM pr")
def k7_evidence_order(spark, sf_dir):
    return threads.evidence_order(_evidence(spark, sf_dir)).select("capture_id", "thread_name", "priority", "place")


@query("j3_thread_contention", _EVIDENCE + " SELECT capture_id, 'user-' || user_id AS thread_name, k AS blocked_waiters, waits, lost AS unresolved FROM ev")
def j3_thread_contention(spark, sf_dir):
    return _evidence(spark, sf_dir).select("capture_id", "thread_name", "blocked_waiters", F.col("monitor_waiter").alias("waits"), "unresolved")


@query("g1_resource_edges", _DAY + " SELECT capture_id, edge, count(*) AS n FROM (SELECT capture_id, 'wait' AS edge FROM w UNION ALL SELECT capture_id, 'hold' FROM h) GROUP BY ALL")
def g1_resource_edges(spark, sf_dir):
    return blocking.resource_edges(threads.lock_observations(_dump(spark, sf_dir))).groupBy("capture_id", "edge").agg(F.count("*").alias("n"))


_FOUND = _EVIDENCE + ", fd AS (SELECT capture_id, 'contention' AS category, CASE WHEN lost THEN 'low' ELSE 'high' END AS confidence, user_id, lock AS resource, 'medium' AS severity FROM ev WHERE waits UNION ALL SELECT capture_id, 'bottleneck', 'medium', user_id, user_id, CASE WHEN k >= 2 THEN 'high' ELSE 'medium' END FROM ev WHERE k > 0)"


def _found(spark, sf_dir):
    d = _dump(spark, sf_dir)
    t, locks = threads.threads(d), threads.lock_observations(d)
    e = threads.thread_evidence(t, locks)
    keys = ["capture_id", "snapshot_index", "start_line"]
    waited = locks.where(F.col("kind").isin(*threads.CONTENDED)).select(*keys, F.col("lock_id").alias("resource"))
    held = locks.where(F.col("kind").isin(*threads.HOLDS)).select(*keys, F.col("lock_id").alias("resource"))
    waits = e.where("monitor_waiter").join(waited, keys).select("capture_id", "snapshot_index", F.lit("contention").alias("category"), F.lit("medium").alias("severity"), F.when(F.col("unresolved"), "low").otherwise("high").alias("confidence"), "thread_name", "resource")
    blocks = e.where("blocked_waiters > 0").join(held, keys).select("capture_id", "snapshot_index", F.lit("bottleneck").alias("category"), F.when(F.col("blocked_waiters") >= 2, "high").otherwise("medium").alias("severity"), F.lit("medium").alias("confidence"), "thread_name", "resource")
    return waits.unionByName(blocks)


@query("a12_problem_summary", _FOUND + " SELECT capture_id, category, count(DISTINCT user_id) AS threads, count(DISTINCT resource) AS resources, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS severity, CASE WHEN bool_or(confidence = 'low') THEN 'low' WHEN bool_or(confidence = 'medium') THEN 'medium' ELSE 'high' END AS confidence FROM fd GROUP BY ALL")
def a12_problem_summary(spark, sf_dir):
    return blocking.problem_summary(_found(spark, sf_dir)).drop("snapshot_index")


@query("k9_finding_order", _FOUND + " SELECT capture_id, category, 'user-' || user_id AS title, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 2 END, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, category || ' user-' || user_id) AS INTEGER) AS place FROM fd")
def k9_finding_order(spark, sf_dir):
    titled = _found(spark, sf_dir).withColumn("title", F.concat_ws(" ", "category", "thread_name"))
    return ordering.finding_order(titled, "capture_id").select("capture_id", "category", F.col("thread_name").alias("title"), "place")


@query("a28_finding_roll_up", _DAY + ", c AS (SELECT capture_id, lock, list_sort(list(waiter)) AS people FROM w GROUP BY ALL), b AS (SELECT c.capture_id, c.lock, CASE WHEN c.lock % 2 = 0 THEN list_sort(list_distinct(list_concat(people, [c.lock]))) ELSE [c.lock] END AS people FROM c) SELECT c.capture_id, 'b' || c.lock AS finding_id, CASE WHEN len(list_filter(c.people, lambda x: NOT list_contains(b.people, x))) = 0 THEN 'c' || c.lock END AS parent FROM c JOIN b ON b.capture_id = c.capture_id AND b.lock = c.lock")
def a28_finding_roll_up(spark, sf_dir):
    locks = threads.lock_observations(_dump(spark, sf_dir))
    who = threads.threads(_dump(spark, sf_dir)).select("capture_id", "start_line", F.substring_index("thread_name", "-", -1).cast("long").alias("user_id"))
    waits = locks.where(F.col("kind").isin(*threads.CONTENDED)).join(who, ["capture_id", "start_line"]).withColumn("lock", F.conv(F.substring("lock_id", 3, 16), 16, 10).cast("long"))
    each = waits.groupBy("capture_id", "lock").agg(F.array_sort(F.collect_set("user_id")).alias("people"))
    above = each.select("capture_id", F.concat(F.lit("c"), "lock").alias("finding_id"), F.lit("observed-lock-contention").alias("kind"), F.array("lock").alias("locks"), "people")
    with_owner = F.when(F.col("lock") % 2 == 0, F.array_sort(F.array_union("people", F.array("lock")))).otherwise(F.array("lock"))
    low = each.select("capture_id", F.concat(F.lit("b"), "lock").alias("finding_id"), F.lit("likely-lock-bottleneck").alias("kind"), F.array("lock").alias("locks"), with_owner.alias("people"))
    return blocking.rolled_up(above.unionByName(low)).where("kind = 'likely-lock-bottleneck'").select("capture_id", "finding_id", "parent")


@query("p8_comparable_snapshots", f"WITH {_E} SELECT event_id, coalesce(lag(us) OVER w IS NOT NULL AND event_type <> 'error' AND lag(event_type) OVER w <> 'error' AND event_id % 7 <> 0 AND lag(event_id) OVER w % 7 <> 0 AND (event_id % 5 = 0 OR lag(event_id) OVER w % 5 = 0 OR event_id % 2 = lag(event_id) OVER w % 2), FALSE) AS comparable FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)")
def p8_comparable_snapshots(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    number = F.col("event_id")
    rows = e.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "error", "partial").otherwise("success").alias("status"), (number % 7 == 0).alias("embedded"), F.lit("all").alias("scope"), F.lit(None).cast("int").alias("segment"), F.when(number % 5 != 0, number % 2).alias("process"))
    return threads.comparable(rows, "user_id", "ts").select("event_id", "comparable")


# --- dependents and patterns over a session ----------------------------------------

_DEP = _EDGES.replace(", x AS (SELECT DISTINCT w.waiter AS source, w.lock AS target FROM w", ", x AS (SELECT DISTINCT w.capture_id, w.waiter AS source, w.lock AS target FROM w") + ", p AS (SELECT capture_id, source, target FROM x UNION SELECT p.capture_id, p.source, x.target FROM p JOIN x ON p.capture_id = x.capture_id AND p.target = x.source), q AS (SELECT capture_id, target AS user_id, count(*) FILTER (WHERE source <> target) AS dependents FROM p GROUP BY ALL), dq AS (SELECT capture_id, target AS user_id, count(*) FILTER (WHERE source <> target) AS direct FROM x GROUP BY ALL)"


def _dependents(spark, sf_dir):
    _checkpoints(spark)
    return blocking.dependents(blocking.dependency_edges(threads.lock_observations(_dump(spark, sf_dir))))


@query("g2_snapshot_edges", _DEP + " SELECT capture_id, 'user-' || source AS waiter, 'user-' || target AS owner, CAST(1 AS BIGINT) AS observations, FALSE AS ambiguous FROM x")
def g2_snapshot_edges(spark, sf_dir):
    d = _dump(spark, sf_dir)
    names = threads.threads(d).select("capture_id", "start_line", "thread_name")
    edges = blocking.dependency_edges(threads.lock_observations(d))
    a, b = names.withColumnsRenamed({"start_line": "waiter", "thread_name": "a"}), names.withColumnsRenamed({"start_line": "owner", "thread_name": "b"})
    return edges.join(a, ["capture_id", "waiter"]).join(b, ["capture_id", "owner"]).select("capture_id", F.col("a").alias("waiter"), F.col("b").alias("owner"), "observations", "ambiguous")


@query("g7_snapshot_dependents", _DEP + " SELECT capture_id, 'user-' || user_id AS blocker, direct, dependents - direct AS indirect, dependents, CAST(0 AS BIGINT) AS uncertain FROM q JOIN dq USING (capture_id, user_id)")
def g7_snapshot_dependents(spark, sf_dir):
    names = threads.threads(_dump(spark, sf_dir)).select("capture_id", "start_line", F.col("thread_name").alias("blocker"))
    return _dependents(spark, sf_dir).join(names, ["capture_id", "start_line"]).select("capture_id", "blocker", "direct", "indirect", "dependents", "uncertain")


def _observed(spark, sf_dir):
    """(blockers over the session with their series, links, rows)."""
    rows, _, links = _session(spark, sf_dir)
    placed = series.series(rows, links)
    named = placed.withColumn("series", F.concat_ws(":", F.col("first_snapshot").cast("string"), "first_key"))
    seen = named.join(_dependents(spark, sf_dir).select("capture_id", "start_line", "dependents"), ["capture_id", "start_line"])
    return seen, links, named


_PAT = _SES.replace("WITH ", "WITH RECURSIVE ", 1) + _DEP[_DEP.index(", x AS (") :] + ", ob AS (SELECT c.session, c.snapshot, c.user_id, c.first_snapshot || ':0x' || lower(printf('%x', c.user_id + 4096)) AS series, q.dependents, l.user_id IS NOT NULL AS linked FROM c JOIN q ON q.capture_id = c.capture_id AND q.user_id = c.user_id LEFT JOIN l ON l.session = c.session AND l.snapshot = c.snapshot AND l.user_id = c.user_id)"


@query("g8_blocking_patterns", _PAT + ", pp AS (SELECT o.session, o.series, count(*) AS snapshots, max(o.dependents) AS peak, count(*) FILTER (WHERE o.linked AND o.dependents > 0 AND b.dependents > 0) AS recurrences FROM ob o LEFT JOIN ob b ON b.session = o.session AND b.user_id = o.user_id AND b.snapshot = o.snapshot - 1 GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY peak DESC, recurrences DESC, series) AS INTEGER) AS rank FROM pp")
def g8_blocking_patterns(spark, sf_dir):
    seen, links, _ = _observed(spark, sf_dir)
    return blocking.patterns(seen, links)


@query("g10_pattern_status", _PAT + ", sn AS (SELECT DISTINCT session, snapshot FROM d), gr AS (SELECT DISTINCT ob.session, series, sn.snapshot FROM ob JOIN sn USING (session)) SELECT gr.session, series, gr.snapshot, CASE WHEN EXISTS (SELECT 1 FROM ob WHERE ob.session = gr.session AND ob.series = gr.series AND ob.snapshot = gr.snapshot) THEN 'observed' WHEN EXISTS (SELECT 1 FROM ob WHERE ob.session = gr.session AND ob.series = gr.series AND ob.snapshot = gr.snapshot - 1) THEN 'not observed' ELSE 'uncertain' END AS status FROM gr")
def g10_pattern_status(spark, sf_dir):
    seen, _, named = _observed(spark, sf_dir)
    snapshots = named.select("session", "snapshot").distinct().withColumn("comparable", F.lit(True))
    return blocking.pattern_status(seen, snapshots)


@query("g8_relation_changes", _PAT + ", li AS (SELECT session, snapshot, user_id FROM l), re AS (SELECT c.session, c.snapshot, x.source, x.target, s.first_snapshot || ':' || s.user_id AS a, t.first_snapshot || ':' || t.user_id AS b FROM x JOIN c s ON s.capture_id = x.capture_id AND s.user_id = x.source JOIN c t ON t.capture_id = x.capture_id AND t.user_id = x.target JOIN c ON c.capture_id = x.capture_id AND c.user_id = x.source), n AS (SELECT r.*, EXISTS (SELECT 1 FROM li WHERE li.session = r.session AND li.snapshot = r.snapshot AND li.user_id = r.source) AND EXISTS (SELECT 1 FROM li WHERE li.session = r.session AND li.snapshot = r.snapshot AND li.user_id = r.target) AS sure, EXISTS (SELECT 1 FROM re o WHERE o.session = r.session AND o.snapshot = r.snapshot - 1 AND o.a = r.a AND o.b = r.b) AS was FROM re r) SELECT session, snapshot, change, count(*) AS n FROM (SELECT session, snapshot, CASE WHEN NOT sure THEN 'uncertain' WHEN was THEN 'observed again' ELSE 'newly observed' END AS change FROM n UNION ALL SELECT r.session, r.snapshot + 1, 'not observed in this snapshot' FROM re r WHERE NOT EXISTS (SELECT 1 FROM re o WHERE o.session = r.session AND o.snapshot = r.snapshot + 1 AND o.a = r.a AND o.b = r.b) AND r.snapshot < (SELECT max(snapshot) FROM d WHERE d.session = r.session)) GROUP BY ALL")
def g8_relation_changes(spark, sf_dir):
    _checkpoints(spark)
    rows, _, links = _session(spark, sf_dir)
    named = series.series(rows, links).withColumn("series", F.concat_ws(":", F.col("first_snapshot").cast("string"), "first_key")).select("session", "snapshot", "capture_id", "start_line", "source_key", "series")
    edges = blocking.dependency_edges(threads.lock_observations(_dump(spark, sf_dir)))
    a = named.select("session", "snapshot", "capture_id", F.col("start_line").alias("waiter_line"), F.col("series").alias("waiter"))
    b = named.select("capture_id", F.col("start_line").alias("owner_line"), F.col("series").alias("owner"))
    relations = edges.select("capture_id", F.col("waiter").alias("waiter_line"), F.col("owner").alias("owner_line")).join(a, ["capture_id", "waiter_line"]).join(b, ["capture_id", "owner_line"])
    linked = named.join(links, ["session", "snapshot", "source_key"], "left_semi").select("session", "snapshot", "series")
    return blocking.relation_changes(relations, linked).groupBy("session", "snapshot", "change").agg(F.count("*").alias("n"))


@query("w7_earlier_evidence", _SES + ", se AS (SELECT *, first_snapshot || ':0x' || lower(printf('%x', user_id + 4096)) AS series FROM c), la AS (SELECT session, series, max(snapshot) AS last_point FROM se WHERE kind = 'purchase' GROUP BY ALL) SELECT session, series, CAST(last_point AS INTEGER) AS last_point, '0x' || lower(printf('%x', user_id // 2)) AS lock_id, CAST(min(snapshot) AS INTEGER) AS first_seen, CAST(max(snapshot) AS INTEGER) AS last_seen, count(*) AS times FROM se JOIN la USING (session, series) WHERE kind = 'error' AND snapshot < last_point GROUP BY ALL")
def w7_earlier_evidence(spark, sf_dir):
    _checkpoints(spark)
    rows, _, links = _session(spark, sf_dir)
    named = series.series(rows, links).withColumn("series", F.concat_ws(":", F.col("first_snapshot").cast("string"), "first_key"))
    locks = threads.lock_observations(_dump(spark, sf_dir)).where(F.col("kind").isin(*threads.CONTENDED)).select("capture_id", "start_line", "lock_id")
    seen = named.join(locks, ["capture_id", "start_line"]).select("session", "series", "snapshot", "lock_id", F.lit("previously-waited-on-lock").alias("relation"), F.lit(None).cast("int").alias("waiters"))
    found = blocking.earlier_evidence(named.where("java_state = 'TIMED_WAITING'").select("session", "series", "snapshot"), seen)
    return found.select("session", "series", F.col("last_point").cast("int").alias("last_point"), "lock_id", F.col("first_seen").cast("int").alias("first_seen"), F.col("last_seen").cast("int").alias("last_seen"), "times")


# --- patterns and scenarios ----------------------------------------------------------


def _scored(spark, sf_dir):
    marked = _trouble(spark, sf_dir)
    detail = marked.select("capture_id", F.regexp_extract("text", r"java\.lang\.Thread\.State: [A-Z_]+ \(([^)]*)\)", 1).alias("state_detail"), (F.col("line_no") - 1).alias("start_line")).where("state_detail <> ''")
    return marked, patterns.scored(threads.threads(marked).join(detail, ["capture_id", "start_line"], "left"))


@query("a6_pattern_scores", _DAY + " SELECT capture_id, 'user-' || user_id AS thread_name, 'parked' AS key, 80 AS score, 'medium' AS confidence FROM t WHERE kind = 'click'")
def a6_pattern_scores(spark, sf_dir):
    rows = _scored(spark, sf_dir)[1]
    return rows.select("capture_id", "thread_name", F.explode("patterns").alias("p")).select("capture_id", "thread_name", "p.key", "p.score", "p.confidence")


@query("a7_scenarios", _DAY + _PAIRS + ", dd AS (SELECT capture_id, user_id FROM z UNION ALL SELECT capture_id, user_id + 1 FROM z), cw AS (SELECT DISTINCT capture_id, user_id % 5 AS c FROM t WHERE kind = 'error'), sc AS (SELECT t.capture_id, t.user_id, CASE WHEN dd.user_id IS NOT NULL THEN 'deadlock' WHEN kind = 'error' THEN 'class-initialization-wait' WHEN kind = 'signup' AND cw.c IS NOT NULL THEN 'class-initializer-with-waiters' WHEN kind = 'click' THEN 'parked' END AS scenario FROM t LEFT JOIN dd USING (capture_id, user_id) LEFT JOIN cw ON cw.capture_id = t.capture_id AND cw.c = t.user_id % 5) SELECT capture_id, scenario, CASE scenario WHEN 'deadlock' THEN 'critical' WHEN 'parked' THEN 'info' WHEN NULL THEN NULL ELSE CASE WHEN scenario IS NOT NULL THEN 'medium' END END AS severity, count(*) AS n FROM sc GROUP BY ALL")
def a7_scenarios(spark, sf_dir):
    marked, rows = _scored(spark, sf_dir)
    keys = ["capture_id", "snapshot_index", "start_line"]
    classes = threads.class_initialization(marked)
    waited = threads.class_chains(classes, threads.threads(marked)).select("capture_id", "snapshot_index", "class_name")
    of_class = classes.join(waited, ["capture_id", "snapshot_index", "class_name"], "left_semi").groupBy(*keys).agg(F.bool_or(F.col("kind") == "class-initialization-wait").alias("class_wait"), F.bool_or(F.col("kind") == "class-initializer").alias("class_initializer"))
    dead = threads.deadlock_entries(marked).select("capture_id", "snapshot_index", "thread_name").distinct().withColumn("deadlocked", F.lit(True))
    told = patterns.scenario(rows.join(of_class, keys, "left").join(dead, ["capture_id", "snapshot_index", "thread_name"], "left"))
    return told.groupBy("capture_id", "scenario", F.col("scenario_severity").alias("severity")).agg(F.count("*").alias("n"))


# --- synchronization patterns, chains and infrastructure ------------------------------

_SYNC = (
    f"WITH {_E}, t AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, user_id, user_id % 12 AS c, user_id // 12 AS dozen, arg_max(event_type, us) AS kind FROM e GROUP BY ALL), s AS (SELECT *, CASE WHEN kind IN ('click', 'purchase') THEN 15 ELSE -25 END AS fits, kind = 'purchase' AS asleep FROM t)"
    ", m AS (SELECT capture_id, user_id, c, dozen, kind, unnest(CASE c WHEN 0 THEN [{'key': 'condition-await', 'score': 85 + fits}] WHEN 1 THEN [{'key': 'latch-await', 'score': 80 + fits}] WHEN 2 THEN [{'key': 'object-wait', 'score': 85 + fits}] WHEN 3 THEN [{'key': 'rwlock-reader-wait', 'score': 85 + fits}] WHEN 4 THEN [{'key': 'rwlock-writer-lock', 'score': 75 + fits}]"
    " WHEN 5 THEN CASE WHEN asleep THEN [{'key': 'rwlock-writer-holder', 'score': 100}, {'key': 'rwlock', 'score': 65}] ELSE [{'key': 'rwlock', 'score': 65}] END WHEN 6 THEN [{'key': 'rwlock', 'score': 60}] WHEN 7 THEN CASE WHEN asleep THEN [{'key': 'reentrant-lock-holder', 'score': 100}] END WHEN 8 THEN [{'key': 'reentrant-lock-contention', 'score': 85 + fits}] WHEN 9 THEN [{'key': 'reentrant-lock-contention', 'score': 55 + fits}] END) AS p FROM s)"
)


def _synchronized(spark, sf_dir):
    marked = generic.cut(threads.snapshots(generic.cut(rendered.lines(rendered.synchronization_dumps(_table(spark, sf_dir, "events")), rendered.USERS))))
    return threads.threads(marked), threads.lock_observations(marked)


@query("a6_synchronization_patterns", _SYNC + " SELECT capture_id, 'user-' || user_id AS thread_name, p.key AS key, p.score AS score, CASE WHEN p.score >= 85 THEN 'high' WHEN p.score >= 60 THEN 'medium' ELSE 'low' END AS confidence FROM m")
def a6_synchronization_patterns(spark, sf_dir):
    told = patterns.synchronization(patterns.evidence(*_synchronized(spark, sf_dir)))
    return told.select("capture_id", "thread_name", F.explode("synchronization").alias("p")).select("capture_id", "thread_name", "p.key", "p.score", "p.confidence")


@query("a6_selector_scores", _SYNC + " SELECT capture_id, 'user-' || user_id AS thread_name, CASE WHEN kind IN ('click', 'purchase') THEN 60 ELSE 85 END AS score FROM t WHERE c = 10")
def a6_selector_scores(spark, sf_dir):
    return patterns.selector(patterns.evidence(*_synchronized(spark, sf_dir))).where("selector IS NOT NULL").select("capture_id", "thread_name", "selector.score")


@query(
    "j2_acquisition_chains",
    # locks are told apart by the printed id alone: the ids of two dozens far enough apart are one lock
    _SYNC + ", k AS (SELECT capture_id, user_id, c, c IN (5, 7) AS held, dozen + CASE WHEN c = 0 THEN 49152 WHEN c IN (3, 5) THEN 45056 ELSE 40960 END AS id, 'java.util.concurrent.locks.' || CASE WHEN c = 0 THEN 'AbstractQueuedSynchronizer$ConditionObject' WHEN c IN (3, 5) THEN 'ReentrantReadWriteLock$NonfairSync' ELSE 'ReentrantLock$NonfairSync' END AS lock_type FROM t WHERE c IN (0, 3, 5, 7, 8, 9))"
    ", o AS (SELECT capture_id, id, count(*) AS owners, arg_min(lock_type, user_id) AS held_type FROM k WHERE held GROUP BY ALL)"
    " SELECT k.capture_id, '0x' || lower(printf('%x', k.id)) AS lock_id, coalesce(max(held_type), arg_min(k.lock_type, k.user_id)) AS lock_type, coalesce(max(o.owners), 0) AS owners, count(*) AS waiters FROM k LEFT JOIN o ON o.capture_id = k.capture_id AND o.id = k.id WHERE NOT k.held AND (o.owners > 0 OR k.c <> 0) GROUP BY k.capture_id, k.id",
)
def j2_acquisition_chains(spark, sf_dir):
    rows, locks = _synchronized(spark, sf_dir)
    return patterns.contention_chains(patterns.classified(rows, locks), locks).drop("snapshot_index")


@query(
    "a7_library_scenarios",
    _SYNC + ", f AS (SELECT capture_id, user_id, arg_max(p.key, CASE p.key WHEN 'rwlock' THEN 0 ELSE 1 END) AS key, arg_max(p.score, CASE p.key WHEN 'rwlock' THEN 0 ELSE 1 END) AS score FROM m GROUP BY ALL), w AS (SELECT t.*, key, score FROM t LEFT JOIN f USING (capture_id, user_id))"
    ", g AS (SELECT capture_id, CASE WHEN key IS NOT NULL THEN key WHEN c = 7 THEN 'sleeping' WHEN c = 10 THEN 'selector-event-loop' WHEN kind = 'click' THEN 'parked' END AS scenario,"
    " CASE WHEN key IN ('rwlock-reader-wait', 'reentrant-lock-contention') THEN 'high' WHEN key IS NOT NULL THEN 'medium' WHEN c IN (7, 10) OR kind = 'click' THEN 'info' END AS severity,"
    " CASE WHEN key IS NOT NULL THEN CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END WHEN c = 7 THEN 'low' WHEN c = 10 OR kind = 'click' THEN 'medium' END AS confidence FROM w)"
    " SELECT capture_id, scenario, severity, confidence, count(*) AS n FROM g GROUP BY ALL",
)
def a7_library_scenarios(spark, sf_dir):
    rows, locks = _synchronized(spark, sf_dir)
    detail = F.when(F.col("java_state") == "WAITING", "parking").when(F.col("java_state") == "TIMED_WAITING", "sleeping")
    told = patterns.scenario(patterns.classified(rows.withColumn("state_detail", detail), locks), "synchronization")
    return told.groupBy("capture_id", "scenario", F.col("scenario_severity").alias("severity"), F.col("scenario_confidence").alias("confidence")).agg(F.count("*").alias("n"))


# --- cycles and chains of a snapshot ----------------------------------------------------

_RING = (
    f"WITH {_E}, t AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, user_id, arg_max(event_type, us) AS kind FROM e GROUP BY ALL), x AS (SELECT w.capture_id, w.user_id AS a, o.user_id AS b, w.user_id // 3 AS ring FROM t w JOIN t o ON o.capture_id = w.capture_id AND o.user_id = w.user_id // 3 * 3 + (w.user_id + 1) % 3 WHERE w.kind IN ('error', 'click', 'signup'))"
    ", k AS (SELECT capture_id, ring, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT capture_id, ring, count(DISTINCT u) AS members FROM (SELECT capture_id, ring, unnest([a, b]) AS u FROM x) GROUP BY ALL)"
)


def _ring_edges(spark, sf_dir):
    marked = generic.cut(threads.snapshots(generic.cut(rendered.lines(rendered.ring_dumps(_table(spark, sf_dir, "events")), rendered.USERS))))
    return generic.cut(blocking.dependency_edges(threads.lock_observations(marked)).unionByName(blocking.class_edges(threads.class_initialization(marked))))


@query("a27_snapshot_cycles", _RING + " SELECT capture_id, CAST(sum(members) AS BIGINT) AS threads, count(*) FILTER (WHERE n = 3) AS cycles, CAST(coalesce(sum(members) FILTER (WHERE n = 3), 0) AS BIGINT) AS cyclic_threads, CAST(sum(n) AS BIGINT) AS edges, CAST(max(CASE WHEN n < 3 THEN n ELSE 0 END) AS INTEGER) AS depth FROM k JOIN m USING (capture_id, ring) GROUP BY 1")
def a27_snapshot_cycles(spark, sf_dir):
    return blocking.cycle_metrics(_ring_edges(spark, sf_dir)).drop("snapshot_index")


@query("g3_snapshot_cycles", _RING + " SELECT capture_id, ring, count(*) AS threads FROM (SELECT capture_id, ring FROM k WHERE n = 3) JOIN (SELECT unnest([0, 1, 2]) AS i) ON TRUE GROUP BY ALL")
def g3_snapshot_cycles(spark, sf_dir):
    edges = _ring_edges(spark, sf_dir)
    name = lambda end: F.concat_ws("\t", "capture_id", F.col(end).cast("string"))
    found = generic.in_cycles(edges.select(F.nullif(name("waiter"), F.lit("")).alias("source"), F.nullif(name("owner"), F.lit("")).alias("target")))
    marked = found.select(F.split("node", "\t")[0].alias("capture_id"), F.split("node", "\t")[1].cast("int").alias("start_line"))
    names = threads.threads(threads.snapshots(generic.cut(rendered.lines(rendered.ring_dumps(_table(spark, sf_dir, "events")), rendered.USERS)))).select("capture_id", "start_line", F.regexp_extract("thread_name", r"(\d+)", 1).cast("long").alias("user_id"))
    return marked.join(names, ["capture_id", "start_line"]).groupBy("capture_id", F.floor(F.col("user_id") / 3).alias("ring")).agg(F.count("*").alias("threads"))


# --- densities of a contention map ---------------------------------------------------------

_MAP = (
    _DAY + ", ml AS (SELECT capture_id, lock, count(*) AS waiters, lock % 7 = 3 AS deadlock FROM w GROUP BY ALL), mo AS (SELECT ml.*, CASE WHEN t.user_id IS NOT NULL AND NOT (t.kind = 'error' AND t.user_id // 2 = t.user_id) THEN 1 ELSE 0 END AS owners FROM ml LEFT JOIN t ON t.capture_id = ml.capture_id AND t.user_id = ml.lock)"
    ", mr AS (SELECT *, CASE WHEN deadlock THEN 0 ELSE row_number() OVER (PARTITION BY capture_id, deadlock ORDER BY waiters * 10000 + owners * 5500 DESC, '0x' || lower(printf('%x', lock))) END AS lock_rank FROM mo)"
    ", mw AS (SELECT mr.*, w.waiter, w.waiter % 2 = 0 AS dead, row_number() OVER (PARTITION BY mr.capture_id, mr.lock ORDER BY w.waiter % 2 = 0 DESC, CASE WHEN w.waiter // 2 = w.waiter THEN 0 ELSE 1 END DESC, 'user-' || w.waiter) AS waiter_rank FROM mr JOIN w USING (capture_id, lock)), ms AS (SELECT * FROM mw WHERE lock_rank <= 3 AND (waiter_rank <= 1 OR deadlock AND dead))"
)


def _contention_map(spark, sf_dir):
    marked = _dump(spark, sf_dir)
    locks = generic.cut(threads.lock_observations(marked))
    people = threads.threads(marked).withColumn("deadlocked", F.regexp_extract("thread_name", r"(\d+)", 1).cast("long") % 2 == 0)
    number = F.conv(F.substring("lock_id", 3, 16), 16, 10).cast("long")
    return blocking.ranked_contention(people, locks, locks.where(number % 7 == 3))


@query("k6_visible_waits", _MAP + " SELECT capture_id, '0x' || lower(printf('%x', lock)) AS lock_id, CAST(lock_rank AS INTEGER) AS lock_rank, 'user-' || waiter AS thread_name, CAST(waiter_rank AS INTEGER) AS waiter_rank FROM ms")
def k6_visible_waits(spark, sf_dir):
    return blocking.visible_contention(_contention_map(spark, sf_dir), (3, 1)).select("capture_id", "lock_id", "lock_rank", "thread_name", "waiter_rank")


@query("k6_hidden_counts", _MAP + " SELECT a.capture_id, a.locks, a.waits, a.locks - coalesce(s.locks, 0) AS hidden_locks, a.waits - coalesce(s.waits, 0) AS hidden_waits FROM (SELECT capture_id, count(DISTINCT lock) AS locks, count(*) AS waits FROM mw GROUP BY 1) a LEFT JOIN (SELECT capture_id, count(DISTINCT lock) AS locks, count(*) AS waits FROM ms GROUP BY 1) s USING (capture_id)")
def k6_hidden_counts(spark, sf_dir):
    return blocking.hidden_contention(_contention_map(spark, sf_dir), (3, 1)).drop("snapshot_index")
