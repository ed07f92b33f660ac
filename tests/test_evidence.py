"""Intervals, rates, thresholds, references and handshake evidence on small tables."""

from pyspark.sql import functions as F

from capturelake.operators import evidence, threads, tls
from tests.test_dumps import marked


def test_comparison_interval(spark):
    rows = [(1, 0, 10_000, 1.0, 11.0), (2, 0, 10_000, 1.0, 60.0), (3, 0, 10_000, 5.0, 1.0), (4, 10, 10, 1.0, 1.0), (5, 0, 2_000, None, 2.0), (6, None, 5, 1.0, 1.05), (7, 0, 10_000, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, before_epoch_ms long, epoch_ms long, before_elapsed_s double, elapsed_s double")
    got = {r.id: (r.basis, r.quality, None if r.interval_ms is None else round(r.interval_ms)) for r in evidence.comparison_interval(df).collect()}
    assert got == {
        1: ("thread-elapsed", "reliable", 10_000), 2: ("unavailable", "conflicting", None), 3: ("unavailable", "conflicting", None), 4: ("unavailable", "unavailable", None),
        5: ("snapshot-time", "estimated", 2_000), 6: ("thread-elapsed", "estimated", 50), 7: ("snapshot-time", "reliable", 10_000),
    }


def test_bounded_rates(spark):
    rows = [(1, 0, 0, 500, 500, 1000.0), (2, 0, 99, 100, 199, 1000.0), (3, 500, 599, 100, 199, 1000.0), (4, None, None, 1, 1, 1000.0), (5, 0, 9, 5, 14, 50.0)]
    df = spark.createDataFrame(rows, "id int, before_low long, before_high long, low long, high long, interval_ms double").withColumns({"quality": F.lit("reliable"), "uncertainty_ms": F.lit(100.0)})
    got = {r.id: (r.status, r.delta_low, r.delta_high, r.rate_low and round(r.rate_low, 3), r.rate_high and round(r.rate_high, 3)) for r in evidence.bounded_rates(df, "low", "high").collect()}
    assert got == {
        1: ("computed", 500, 500, 500.0, 500.0), 2: ("bounded", 1, 199, 0.909, 221.111), 3: ("counter-reset", None, None, None, None), 4: ("counter-missing", None, None, None, None),
        5: ("bounded", 0, 14, None, None),
    }


def test_cpu_thresholds(spark):
    rows = [(1, 30.0, 300.0, "reliable"), (2, 10.0, 300.0, "reliable"), (3, 6.0, 5000.0, "reliable"), (4, 50.0, 5000.0, "estimated"), (5, None, 5000.0, "reliable"), (6, 25.0, 200.0, "reliable")]
    df = spark.createDataFrame(rows, "id int, percent double, interval_ms double, quality string")
    got = {r.id: (r.cpu_status, r.finding, r.scenario) for r in evidence.evaluate_cpu(df).collect()}
    assert got == {
        1: ("measured-high-rate-short-interval", "high", "high"), 2: ("sample-too-short", None, None), 3: ("measured-rate", "medium", "medium"), 4: ("interval-imprecise", None, None),
        5: ("rate-unavailable", None, None), 6: ("sample-too-short", None, None),
    }
    quiet = {r.id: r.finding for r in evidence.evaluate_cpu(df, "high-throughput", F.lit("infrastructure")).collect()}
    assert quiet[3] is None


def test_references(spark):
    t = spark.createDataFrame([("c", 0, "k1", "a", []), ("c", 0, "k2", "b", ["0x1"]), ("c", 0, "k3", "b", []), ("c", 0, "k4", "d", []), ("c", 0, "k5", "d", [])], "capture_id string, snapshot_index int, source_key string, thread_name string, waiting_locks array<string>")
    refs = [(1, "k4", "x", []), (2, None, "a", []), (3, None, "b", ["0x1"]), (4, None, "d", ["0x1"]), (5, None, "zz", []), (6, None, None, [])]
    df = spark.createDataFrame([("c", 0, *r) for r in refs], "capture_id string, snapshot_index int, ref_id int, ref_key string, ref_name string, ref_locks array<string>")
    got = {r.ref_id: (r.status, r.reason, r.resolved_key) for r in evidence.resolve_references(df, t).collect()}
    assert got == {
        1: ("resolved", "exact-source-key", "k4"), 2: ("resolved", "unique-name", "k1"), 3: ("resolved", "name-and-waiting-lock", "k2"), 4: ("ambiguous", "duplicate-name-without-unique-evidence", None),
        5: ("missing", "name-not-found", None), 6: ("missing", "name-not-supplied", None),
    }


def test_deadlock_annotation(spark):
    d = marked(spark)
    t = threads.threads(d).withColumn("source_key", F.col("jvm_id")).withColumn("waiting_locks", F.array().cast("array<string>"))
    got = [(r.thread_name, r.waiter_key, r.holder_key, r.mapped) for r in evidence.annotate_deadlocks(threads.deadlock_entries(d), t).orderBy("entry_no").collect()]
    assert got == [("alpha", "1", "2", True), ("beta", "2", "1", True)]


def test_lcs_and_trend(spark):
    rows = [(1, list("abcde"), list("axcye")), (2, [], list("ab")), (3, list("ab"), []), (4, list("aaa"), list("aa")), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>")
    got = {r.id: (r.same, r.removed, r.added) for r in evidence.stack_diff(df, "a", "b").collect()}
    assert got == {1: (3, 2, 2), 2: (0, 0, 2), 3: (0, 2, 0), 4: (2, 1, 0), 5: (0, 0, 0)}
    series = {"Growing": [1, 2], "Fading": [2, 1], "Persistent": [1, 2, 1], "Bursty": [0, 1, 0, 1], "Intermittent": [1, 0, 1, 1], "Stable": [0, 1, 2, 1], "None": [0, 0], "Unavailable": [1, None]}
    flat = spark.createDataFrame([(k, i, n) for k, ns in series.items() for i, n in enumerate(ns)], "k string, i int, n long")
    assert all(r.k == r.trend for r in evidence.count_trend(flat, "i", "k").collect())


def test_fingerprints(spark):
    df = spark.createDataFrame([(["at java.lang.Thread.run(Thread.java:1)", "at java.util.List.get(List.java:9)", "at app.A.b(A.java:3)"],), ([],)], "frames array<string>")
    got = [(r.strict_fingerprint, r.app_fingerprint) for r in evidence.fingerprints(df).collect()]
    assert got == [("java.util.List.get(List.java) | app.A.b(A.java)", "app.A.b(A.java)"), ("", "")]


def test_handshake_evidence(spark):
    messages = ["Produced ClientHello handshake message", "Produced server Finished handshake message", "javax.net.ssl.SSLHandshakeException: late", "Consuming ClientHello handshake message", "SocketTimeoutException: Read timed out", "Consuming ServerHello handshake message", "PKIX path building failed: x", "Sent fatal alert: bad_certificate"]
    rows = spark.createDataFrame([("c", i, "1", i, m) for i, m in enumerate(messages)], "capture_id string, record_no long, tid string, epoch_ms long, message string")
    got = {r.interaction: (r.direction, r.failure_key, r.outcome, r.diagnosis) for r in tls.interaction_facts(rows).collect()}
    assert got == {1: ("outbound", None, "success", "Finished exchange observed"), 2: ("inbound", "pkix", "failure", "pkix")}


def test_alerts(spark):
    rows = [("Received alert message (", '"Alert": {\n "level" : "warning",\n "description": "bad_record_mac"\n}', "TLSv1.3"), ("Produced alert message", '"level": "fatal", "description": "internal_error"', None), ("Consuming alert message", '"level": "warning", "description": "close_notify"', "TLSv1.3"), ("Other", "", None)]
    df = spark.createDataFrame(rows, "m string, b string, v string").select(tls.alert(F.col("m"), F.col("b"), F.col("v")).alias("a"))
    assert [tuple(r.a) if r.a else None for r in df.collect()] == [("warning", "bad_record_mac", "Received", True), ("fatal", "internal_error", "Sent", True), ("warning", "close_notify", "Received", False), None]
