"""Queries of operators.evidence and of handshake facts, added to the catalogue.

Where rates are judged, the days of the rendered session stand for minutes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import evidence, series, threads, tls
from capturelake.plans import rendered
from capturelake.plans.catalogue import _DAY, _SES, _TLS, _dump, _session, _session_threads, _table, _tls_records, query

_INTERVAL = ", q AS (SELECT *, m > m0 AND abs(gap - (m - m0) * 1000) > 1010 AS apart FROM l), iv AS (SELECT *, 'user-' || user_id AS thread_name, CASE WHEN apart THEN 'conflicting' ELSE 'reliable' END AS quality, CASE WHEN apart THEN NULL WHEN m > m0 THEN (m - m0) * 1000 ELSE gap END AS interval_ms FROM q)"
_MINUTES = ", mi AS (SELECT *, gap // 1440 AS ms, round((cpu - cpu0) * 100.0::DOUBLE / (gap // 1440), 6) AS pct, (cpu - cpu0) * 100000000.0::DOUBLE / (gap // 1440) AS bytes_s FROM l WHERE cpu >= cpu0)"


def _linked(spark, sf_dir, *columns):
    rows, _, links = _session(spark, sf_dir)
    low = (F.floor(F.col("cpu_ms") / 1000) * 1000).cast("long")
    rows = rows.withColumn("low", low).withColumn("high", F.col("low") + 999)
    return series.with_before(rows, links, "cpu_ms", "epoch_ms", "elapsed_s", "low", "high", *columns)


@query("w1_comparison_interval", _SES + _INTERVAL + " SELECT session, snapshot, thread_name, quality, CASE WHEN apart THEN 'unavailable' WHEN m > m0 THEN 'thread-elapsed' ELSE 'snapshot-time' END AS basis, CAST(interval_ms AS BIGINT) AS interval_ms FROM iv")
def w1_comparison_interval(spark, sf_dir):
    return evidence.comparison_interval(_linked(spark, sf_dir)).select("session", "snapshot", "thread_name", "quality", "basis", F.col("interval_ms").cast("long").alias("interval_ms"))


@query(
    "w3_bounded_rates",
    _SES + _INTERVAL + ", b AS (SELECT *, cpu // 1000 * 1000 AS lo, cpu // 1000 * 1000 + 999 AS hi, cpu0 // 1000 * 1000 AS lo0, cpu0 // 1000 * 1000 + 999 AS hi0 FROM iv) SELECT session, snapshot, thread_name, CASE WHEN hi < lo0 THEN 'counter-reset' WHEN apart THEN 'interval-conflict' ELSE 'bounded' END AS status, CASE WHEN hi >= lo0 THEN greatest(0, lo - hi0) END AS delta_low, CASE WHEN hi >= lo0 THEN greatest(0, hi - lo0) END AS delta_high, CASE WHEN hi >= lo0 AND NOT apart THEN round(greatest(0, hi - lo0) * 1000.0::DOUBLE / (interval_ms - 1000), 6) END AS rate_high FROM b",
)
def w3_bounded_rates(spark, sf_dir):
    rates = evidence.bounded_rates(evidence.comparison_interval(_linked(spark, sf_dir)), "low", "high")
    return rates.select("session", "snapshot", "thread_name", "status", "delta_low", "delta_high", F.round("rate_high", 6).alias("rate_high"))


def _minute_rates(spark, sf_dir):
    both = _linked(spark, sf_dir).withColumn("delta", F.col("cpu_ms") - F.col("before_cpu_ms")).where("delta >= 0")
    both = both.withColumn("interval_ms", F.floor((F.col("epoch_ms") - F.col("before_epoch_ms")) / 1440)).withColumn("quality", F.lit("reliable"))
    return both.withColumn("percent", F.round(F.col("delta") * 100 / F.col("interval_ms"), 6)).withColumn("rate_low", F.col("delta") * 100_000_000 / F.col("interval_ms"))


_GRADES = "CASE WHEN pct >= 20 THEN 'high' WHEN pct >= 2 THEN 'medium' END AS finding, CASE WHEN pct >= 10 THEN 'high' WHEN pct >= 5 THEN 'medium' END AS scenario"


@query("a9_cpu_thresholds", _SES + _MINUTES + f" SELECT session, snapshot, 'user-' || user_id AS thread_name, 'measured-rate' AS cpu_status, {_GRADES} FROM mi")
def a9_cpu_thresholds(spark, sf_dir):
    return evidence.evaluate_cpu(_minute_rates(spark, sf_dir)).select("session", "snapshot", "thread_name", "cpu_status", "finding", "scenario")


@query("a10_allocation_thresholds", _SES + _MINUTES + " SELECT session, snapshot, 'user-' || user_id AS thread_name, bytes_s >= 1048576 AS hot, bytes_s >= 10485760 AS hot_scenario, bytes_s >= 67108864 AS high FROM mi")
def a10_allocation_thresholds(spark, sf_dir):
    return evidence.evaluate_allocation(_minute_rates(spark, sf_dir)).select("session", "snapshot", "thread_name", "hot", "hot_scenario", "high")


@query(
    "a8_thread_findings",
    _SES + _MINUTES + f", b AS (SELECT h.capture_id, h.user_id, count(DISTINCT w.waiter) AS k FROM h JOIN w ON h.capture_id = w.capture_id AND h.user_id = w.lock GROUP BY ALL), gr AS (SELECT *, {_GRADES} FROM mi), f AS (SELECT session, snapshot, capture_id, user_id, unnest([CASE WHEN finding IS NOT NULL THEN 'cpu-hot' END, CASE WHEN bytes_s >= 1048576 THEN 'allocation-hot' END, CASE WHEN k >= 2 THEN 'many-waiters' END, CASE WHEN kind <> 'error' AND k > 0 THEN 'likely-lock-bottleneck' END]) AS key, unnest([finding, CASE WHEN bytes_s >= 67108864 THEN 'high' ELSE 'medium' END, 'medium', 'medium']) AS severity FROM gr LEFT JOIN b USING (capture_id, user_id)) SELECT session, snapshot, 'user-' || user_id AS thread_name, key, severity FROM f WHERE key IS NOT NULL",
)
def a8_thread_findings(spark, sf_dir):
    d = _dump(spark, sf_dir)
    t, locks = threads.threads(d), threads.lock_observations(d)
    keys = ["capture_id", "snapshot_index"]
    who = threads.degrees(t, locks).select(*keys, "start_line", F.col("blocks").alias("waiters"))
    tiers = threads.severity(t, locks).select(*keys, "thread_name", "tier")
    judged = evidence.evaluate_allocation(evidence.evaluate_cpu(_minute_rates(spark, sf_dir))).withColumn("infrastructure", F.lit(False))
    return evidence.findings(judged.join(who, [*keys, "start_line"]).join(tiers, [*keys, "thread_name"]), many=2).select("session", "snapshot", "thread_name", "key", "severity")


@query(
    "j12_lock_transitions",
    _SES + ", cw AS (SELECT DISTINCT capture_id, lock FROM w), x AS (SELECT l.session, l.snapshot, l.user_id, NOT (l.kind = 'error' AND l.user_id = 0) AS now_, NOT (l.kind0 = 'error' AND l.user_id = 0) AS was, l.capture_id, p.capture_id AS before_id FROM l JOIN (SELECT DISTINCT session, snapshot, capture_id FROM d) p ON p.session = l.session AND p.snapshot = l.snapshot - 1) SELECT session, snapshot, 'user-' || user_id AS thread_name, CAST(now_ AND was AS INTEGER) AS held_at_both, CAST(now_ AND NOT was AS INTEGER) AS appeared, CAST(was AND NOT now_ AS INTEGER) AS gone, CAST(now_ AND was AND a.lock IS NOT NULL AND b.lock IS NOT NULL AS INTEGER) AS contended_at_both FROM x LEFT JOIN cw a ON a.capture_id = x.capture_id AND a.lock = x.user_id LEFT JOIN cw b ON b.capture_id = x.before_id AND b.lock = x.user_id",
)
def j12_lock_transitions(spark, sf_dir):
    rows, _, links = _session(spark, sf_dir)
    keys = ["capture_id", "snapshot_index"]
    locks = threads.lock_observations(_dump(spark, sf_dir))
    contended = threads.relations(locks).where("owner IS NOT NULL").groupBy(*keys, F.col("owner").alias("start_line")).agg(F.collect_set("lock_id").alias("contended_locks"))
    held = locks.where(F.col("kind").isin(*threads.HOLDS)).groupBy(*keys, "start_line").agg(F.collect_set("lock_id").alias("held_locks"))
    full = rows.join(held, [*keys, "start_line"], "left").join(contended, [*keys, "start_line"], "left")
    names = ("held_at_both", "appeared", "gone", "contended_at_both")
    moved = evidence.lock_transitions(series.with_before(full, links, "held_locks", "contended_locks"))
    return moved.select("session", "snapshot", "thread_name", *[F.size(c).alias(c) for c in names])


@query(
    "j9_process_segments",
    "WITH p AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS pid FROM events), q AS (SELECT *, coalesce(CAST(pid <> last_value(pid IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS c FROM p) SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS segment FROM q",
)
def j9_process_segments(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("pid"))
    return evidence.process_segments(e, "user_id", "ts", "pid").select("event_id", "segment")


@query(
    "j5_thread_references",
    _DAY + " SELECT a.capture_id, 'user-' || a.user_id AS thread_name, CASE WHEN b.user_id IS NULL THEN 'missing' ELSE 'resolved' END AS status, CASE WHEN b.user_id IS NULL THEN 'name-not-found' ELSE 'unique-name' END AS reason, '0x' || lower(printf('%x', b.user_id + 4096)) AS resolved_key FROM t a LEFT JOIN t b ON b.capture_id = a.capture_id AND b.user_id = a.user_id // 2",
)
def j5_thread_references(spark, sf_dir):
    t = series.source_keys(threads.threads(_dump(spark, sf_dir))).withColumn("waiting_locks", F.array().cast("array<string>"))
    half = F.concat(F.lit("user-"), F.floor(F.substring_index("thread_name", "-", -1).cast("long") / 2).cast("string"))
    refs = t.select("capture_id", "snapshot_index", F.col("thread_name").alias("ref_id"), F.lit(None).cast("string").alias("ref_key"), half.alias("ref_name"), F.array().cast("array<string>").alias("ref_locks"))
    return evidence.resolve_references(refs, t).select("capture_id", F.col("ref_id").alias("thread_name"), "status", "reason", "resolved_key")


@query("t17_fingerprints", _DAY + " SELECT capture_id, 'app.Handler' || m % 7 || '.run(Handler.java) | app.Main.loop(Main.java)' AS app_fingerprint, count(*) AS threads FROM t GROUP BY ALL")
def t17_fingerprints(spark, sf_dir):
    return evidence.fingerprints(threads.threads(_dump(spark, sf_dir))).groupBy("capture_id", "app_fingerprint").agg(F.count("*").alias("threads"))


@query("c5_stack_diff", _SES + " SELECT session, snapshot, 'user-' || user_id AS thread_name, 1 + CAST(m % 7 = m0 % 7 AS INTEGER) AS same, CAST(m % 7 <> m0 % 7 AS INTEGER) AS removed, CAST(m % 7 <> m0 % 7 AS INTEGER) AS added FROM l")
def c5_stack_diff(spark, sf_dir):
    rows, _, links = _session(spark, sf_dir)
    both = series.with_before(rows.withColumn("lines", threads.normalize_frames("frames")), links, "lines")
    return evidence.stack_diff(both, "before_lines", "lines").select("session", "snapshot", "thread_name", "same", "removed", "added")


_TIMELINE = ", z AS (SELECT session, snapshot, 'app.Handler' || m % 7 || '.run(Handler.java) | app.Main.loop(Main.java)' AS stack FROM d WHERE java_state = 'RUNNABLE'), gd AS (SELECT s.session, s.snapshot, g.stack FROM (SELECT DISTINCT session, snapshot FROM d) s JOIN (SELECT DISTINCT session, stack FROM z) g USING (session)), tl AS (SELECT session, stack, snapshot, count(z.stack) AS n FROM gd LEFT JOIN z USING (session, stack, snapshot) GROUP BY ALL), a AS (SELECT session, stack, count(*) AS places, count(*) FILTER (WHERE n > 0) AS seen, min(snapshot) FILTER (WHERE n > 0) AS f, max(snapshot) FILTER (WHERE n > 0) AS t, arg_min(n, snapshot) FILTER (WHERE n > 0) AS n0, arg_max(n, snapshot) FILTER (WHERE n > 0) AS n1 FROM tl GROUP BY ALL)"


@query(
    "w9_cluster_trend",
    _SES + _TIMELINE + " SELECT session, stack, seen, CASE WHEN seen = places THEN CASE WHEN n1 > n0 THEN 'Growing' WHEN n1 < n0 THEN 'Fading' ELSE 'Persistent' END WHEN seen <= 2 THEN 'Bursty' WHEN t - f + 1 > seen THEN 'Intermittent' WHEN n1 > n0 THEN 'Growing' WHEN n1 < n0 THEN 'Fading' ELSE 'Stable' END AS trend FROM a",
)
def w9_cluster_trend(spark, sf_dir):
    rows = _session_threads(spark, sf_dir)
    stacks = evidence.fingerprints(rows.where("java_state = 'RUNNABLE'")).select("session", "snapshot", F.col("app_fingerprint").alias("stack"))
    places = rows.select("session", "snapshot").distinct().withColumn("complete", F.lit(True))
    return evidence.count_trend(evidence.count_timeline(stacks, places, "session", "stack", "snapshot"), "snapshot", "session", "stack")


@query(
    "w15_interval_matrix",
    _SES + _MINUTES + ", p AS (SELECT session, 'user-' || user_id AS thread_name, max(pct) FILTER (WHERE snapshot = 2) AS i2, max(pct) FILTER (WHERE snapshot = 3) AS i3, max(pct) FILTER (WHERE snapshot = 4) AS i4, max(pct) FILTER (WHERE snapshot = 5) AS i5 FROM mi GROUP BY ALL), g AS (SELECT *, greatest(i2, i3, i4, i5) AS highest FROM p) SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY highest DESC, thread_name) AS INTEGER) AS rank FROM g WHERE highest IS NOT NULL QUALIFY rank <= 20",
)
def w15_interval_matrix(spark, sf_dir):
    wide = evidence.interval_matrix(_minute_rates(spark, sf_dir), "session", "thread_name", "snapshot", "percent", [2, 3, 4, 5], 20)
    return wide.withColumnsRenamed({str(i): f"i{i}" for i in (2, 3, 4, 5)})


@query(
    "w15_interval_rows",
    _SES + _MINUTES + ", cl AS (SELECT session, 'user-' || user_id AS thread_name, snapshot, max(pct) AS percent FROM mi GROUP BY ALL), bs AS (SELECT session, thread_name, max(percent) AS highest FROM cl GROUP BY ALL HAVING highest IS NOT NULL), tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY session ORDER BY highest DESC, thread_name) AS INTEGER) AS rank FROM bs QUALIFY rank <= 20) SELECT session, thread_name, snapshot, percent, highest, rank FROM tp JOIN (SELECT DISTINCT session, snapshot FROM cl) USING (session) LEFT JOIN cl USING (session, thread_name, snapshot)",
)
def w15_interval_rows(spark, sf_dir):
    return evidence.interval_rows(_minute_rates(spark, sf_dir), "session", "thread_name", "snapshot", "percent", 20)


@query(
    "a27_graph_metrics",
    _DAY + ", k AS (SELECT capture_id, lock FROM w UNION SELECT capture_id, user_id FROM h), f AS (SELECT w.capture_id, w.lock, count(*) AS n, count(h.user_id) AS owned FROM w LEFT JOIN h ON h.capture_id = w.capture_id AND h.user_id = w.lock GROUP BY ALL), fs AS (SELECT capture_id, count(*) AS contended_locks, max(n) AS largest_fan_in, sum(n) AS wait_relations, sum(n - owned) AS unresolved_waits FROM f GROUP BY 1) SELECT t.capture_id, count(*) AS threads, CAST(0 AS BIGINT) AS isolated_threads, any_value(kk.n) AS locks, any_value(kk.n) AS monitors, CAST(0 AS BIGINT) AS synchronizers, coalesce(any_value(contended_locks), 0) AS contended_locks, coalesce(any_value(largest_fan_in), 0) AS largest_fan_in, any_value(hh.n) AS hold_relations, CAST(coalesce(any_value(wait_relations), 0) AS BIGINT) AS wait_relations, CAST(coalesce(any_value(unresolved_waits), 0) AS BIGINT) AS unresolved_waits, CAST(0 AS BIGINT) AS ambiguous_waits FROM t JOIN (SELECT capture_id, count(*) AS n FROM k GROUP BY 1) kk USING (capture_id) JOIN (SELECT capture_id, count(*) AS n FROM h GROUP BY 1) hh USING (capture_id) LEFT JOIN fs USING (capture_id) GROUP BY 1",
)
def a27_graph_metrics(spark, sf_dir):
    d = _dump(spark, sf_dir)
    return evidence.graph_metrics(threads.threads(d), threads.lock_observations(d)).drop("snapshot_index")


_FACTS = _TLS + ", fa AS (SELECT capture_id, tid, CAST(interaction AS BIGINT) AS interaction, bool_or(event_type = 'signup') AS hello, count(*) FILTER (WHERE event_type = 'view') AS server, count(*) FILTER (WHERE event_type = 'purchase') AS done, bool_or(event_type = 'error') AS failed FROM r GROUP BY ALL), fb AS (SELECT *, server > 1 OR done > 1 AS ambiguous FROM fa), fc AS (SELECT *, CASE WHEN ambiguous THEN 'unknown' WHEN failed THEN 'failure' WHEN done > 0 THEN 'success' ELSE 'unknown' END AS outcome FROM fb)"


def _facts(spark, sf_dir):
    return tls.interaction_facts(_tls_records(spark, sf_dir))


@query("l5_failure_keys", _FACTS + " SELECT capture_id, tid, interaction, CASE WHEN failed THEN 'fatal_handshake_failure' END AS failure_key, ambiguous, outcome FROM fc")
def l5_failure_keys(spark, sf_dir):
    return _facts(spark, sf_dir).select("capture_id", "tid", "interaction", "failure_key", "ambiguous", "outcome")


@query("l6_outcomes", _FACTS + " SELECT capture_id, outcome, count(*) AS n FROM fc GROUP BY ALL")
def l6_outcomes(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("capture_id", "outcome").agg(F.count("*").alias("n"))


@query("l8_ambiguous_interactions", _FACTS + " SELECT capture_id, tid, interaction FROM fc WHERE ambiguous")
def l8_ambiguous_interactions(spark, sf_dir):
    return _facts(spark, sf_dir).where("ambiguous").select("capture_id", "tid", "interaction")


@query("l9_directions", _FACTS + " SELECT capture_id, CASE WHEN hello THEN 'outbound' ELSE 'unknown' END AS direction, count(*) AS n FROM fc GROUP BY ALL")
def l9_directions(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("capture_id", "direction").agg(F.count("*").alias("n"))


@query(
    "l14_diagnosis_coverage",
    _FACTS + " SELECT capture_id, tid, interaction, 'ClientHello: ' || CASE WHEN hello THEN 'observed' ELSE 'not captured' END || '; ServerHello: ' || CASE WHEN server > 0 THEN 'observed' ELSE 'not captured' END || '; Finished exchange: ' || CASE WHEN done > 0 THEN 'observed' ELSE 'not captured' END AS coverage, CASE WHEN ambiguous THEN 'Grouping uncertain' WHEN outcome = 'failure' THEN 'fatal handshake failure' WHEN outcome = 'success' THEN 'Finished exchange observed' ELSE 'No final outcome captured' END AS diagnosis FROM fc",
)
def l14_diagnosis_coverage(spark, sf_dir):
    return _facts(spark, sf_dir).select("capture_id", "tid", "interaction", "coverage", "diagnosis")


@query("k8_best_package", "SELECT o_orderpriority, arg_max(o_orderkey, ([o_orderkey % 20, o_custkey % 30], o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def k8_best_package(spark, sf_dir):
    packages = _table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.format_string("%d.%d", F.col("o_orderkey") % 20, F.col("o_custkey") % 30).alias("version"))
    return evidence.best_package(packages, "o_orderpriority", "version", "o_orderkey").select("o_orderpriority", "o_orderkey")


_V = "nullif(array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = '{0}')), ', '), '') AS \"{0}\""


@query("a25_evidence_matrix", f"SELECT CAST(year(o_orderdate) AS INTEGER) AS version, {_V.format('F')}, {_V.format('O')}, {_V.format('P')} FROM orders GROUP BY 1")
def a25_evidence_matrix(spark, sf_dir):
    cases = _table(spark, sf_dir, "orders").withColumn("version", F.year("o_orderdate"))
    return evidence.evidence_matrix(cases, "version", "o_orderstatus", "o_orderpriority", ["F", "O", "P"])
