"""Records of mixed handshake logs, certificate facts, carried values, snapshot heads and collector labels on small logs."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from capturelake.operators import carry, gc, generic, threads, tls

MIXED = """\
noise before any record
javax.net.ssl|DEBUG|1E|worker-1|2024-01-01 00:00:00.001 UTC|ClientHello.java:1|Produced ClientHello handshake message (
"ClientHello": {
  "server_name (0)": { type=host_name (0), value=a.example }
}
)
{
  "logger"     : "javax.net.ssl",
  "level"      : "DEBUG",
  "thread id"  : "2F",
  "thread name": "worker-2",
  "time"       : "2024-01-01 00:00:01.000 UTC",
  "caller"     : "X.java:2",
  "message"    : "Consuming ServerHello handshake message",
  "specifics"  : [
    { "server version" : "TLSv1.2" }
  ]
}
main, READ: TLSv1 Handshake, length = 10
*** ClientHello, TLSv1.2
RandomCookie:  bytes
*** Ignored title
*** ServerHello, TLSv1.2
main, WRITE: TLSv1.2 Handshake, length = 20
*** CertificateRequest
Cert Authorities:
<CN=Old Root, O=Example>
<CN=Second>
*** Certificate chain
Subject: CN="Last, First", O=Example
*** Finished
main, READ: TLSv1.2 Handshake, length = 30
*** Finished
main, handling exception: javax.net.ssl.SSLHandshakeException: no
javax.net.ssl.SSLHandshakeException: no
	at X.y(Z.java:1)
javax.net.ssl|ERROR|1E|worker-1|2024-01-01 24:00:02.000 UTC|Y.java:1|Fatal (HANDSHAKE_FAILURE): no (
javax.net.ssl.SSLHandshakeException: no
)
{
  "logger"     : "javax.net.ssl",
  "level"      : "DEBUG",
  "time"       : "2024-01-01 00:00:01.000 UTC"
}
"""


def lines_of(spark, **logs):
    rows = [(k, i, t) for k, log in logs.items() for i, t in enumerate(log.split("\n")[: -1 if log.endswith("\n") else None], 1)]
    return spark.createDataFrame(rows, "capture_id string, line_no int, text string").repartition(3)


def test_mixed_formats_keep_lines_under_their_own_thread(spark):
    want = [
        (2, "compact", "1e", "worker-1", "Produced ClientHello handshake message (", 5),
        (7, "expanded", "2f", "worker-2", "Consuming ServerHello handshake message", 12),
        (19, "legacy", "legacy", "main", "main, READ: TLSv1 Handshake, length = 10", 1),
        (20, "legacy", "legacy", "main", "Consuming ClientHello handshake message", 3),
        (23, "legacy", "legacy", "main", "Produced ServerHello handshake message *** ServerHello, TLSv1.2", 1),
        (24, "legacy", "legacy", "main", "main, WRITE: TLSv1.2 Handshake, length = 20", 1),
        (25, "legacy", "legacy", "main", "CertificateRequest handshake message", 4),
        (29, "legacy", "legacy", "main", "Consuming client Certificate message", 2),
        (31, "legacy", "legacy", "main", "Produced Finished handshake message", 1),
        (32, "legacy", "legacy", "main", "main, READ: TLSv1.2 Handshake, length = 30", 1),
        (33, "legacy", "legacy", "main", "Consuming Finished handshake message", 1),
        (34, "legacy", "legacy", "main", "main, handling exception: javax.net.ssl.SSLHandshakeException: no", 1),
        (35, "legacy", "legacy", "main", "javax.net.ssl.SSLHandshakeException: no", 2),
        (37, "compact", "1e", "worker-1", "Fatal (HANDSHAKE_FAILURE): no (", 3),
        (40, "unparsed", None, None, None, 5),
    ]
    for width in (None, 3):
        got = tls.records(lines_of(spark, a=MIXED, b=MIXED), width).orderBy("capture_id", "record_no").collect()
        for log in "ab":
            assert [(r.source_start, r.format, r.tid, r.thread, r.message, r.line_count) for r in got if r.capture_id == log] == want
        by = {r.source_start: r for r in got}
        assert by[2].epoch_ms == 1_704_067_200_001 and by[37].epoch_ms == 1_704_067_202_000 and by[20].epoch_ms is None
        assert "server version" in by[7].body and "thread id" not in by[7].body and by[20].body == "RandomCookie:  bytes\n*** Ignored title"


def test_legacy_ends_and_threads(spark):
    client = "*** ClientHello, TLSv1.2\nx, WRITE: TLSv1.2 Handshake\nx, READ: TLSv1.2 Handshake\n*** ServerHello, TLSv1.2\n*** Certificate chain\n*** Finished\n*** ClientHello, TLSv1.2\n"
    shared = "x, READ: TLSv1.2 Handshake\n*** ClientHello, TLSv1.2\ny, WRITE: TLSv1.2 Handshake\n"
    got = tls.records(lines_of(spark, client=client, shared=shared)).orderBy("record_no").collect()
    assert [r.message for r in got if r.capture_id == "client" and "," not in r.message[:3]] == [
        "Produced ClientHello handshake message", "Consuming ServerHello handshake message *** ServerHello, TLSv1.2", "Server Certificate message", "Consuming Finished handshake message", "Consuming ClientHello handshake message",
    ]
    assert {r.thread for r in got if r.capture_id == "shared"} == {None} and all(r.ambiguous == (r.capture_id == "shared") for r in got)
    facts = {r.capture_id: r for r in tls.facts(tls.placed(tls.records(lines_of(spark, shared=shared)))).collect()}
    assert facts["shared"].ambiguous and facts["shared"].outcome == "unknown"


def test_names_with_quotes_and_escapes(spark):
    names = ['CN="Last, First", O=x', r"O=a\, CN\=no, CN=real \"q\", C=SE", 'O="CN=inside, CN=too", cn = x\\+y ', "O=only", "", None, r'CN="a \" b, c"']
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", tls.common_name(F.col("n")).alias("cn")).orderBy("i").collect()
    assert [r.cn for r in got] == ["Last, First", 'real "q"', "x+y", None, None, None, 'a " b, c']
    texts = ['x "certificate authorities": [CN=A, O=b]\n)', '"certificate authorities": [\n  "CN=[x], O=\\"y\\"",\n "CN=B", "CN=[x]", \n]', '"Certificate  Authorities" : [CN=A, O=b,\nCN=open', "none"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tls.listed_names(F.col("t")).alias("l")).orderBy("i").collect()
    assert [(list(r.l.names), r.l.complete) if r.l else None for r in rows] == [(["CN=A, O=b"], True), (['CN=[x], O=\\"y\\"', "CN=B", "CN=[x]"], True), (["CN=A, O=b", "CN=open"], False), None]


def test_certificates_of_interactions(spark):
    log = (
        "javax.net.ssl|DEBUG|01|t|2024-01-01 00:00:00.001 UTC|a|Produced ClientHello handshake message\n"
        'javax.net.ssl|DEBUG|01|t|2024-01-01 00:00:00.002 UTC|a|Consuming CertificateRequest handshake message (\n"certificate authorities": ["CN=A", "CN=B"]\n)\n'
        'javax.net.ssl|DEBUG|01|t|2024-01-01 00:00:00.003 UTC|a|Produced client Certificate handshake message (\n  "subject"            : "CN=\\"one, two\\", O=x",\n  "subject" : "CN=later"\n)\n'
        'javax.net.ssl|DEBUG|02|t|2024-01-01 00:00:00.004 UTC|a|Produced ClientHello handshake message\njavax.net.ssl|DEBUG|02|t|2024-01-01 00:00:00.005 UTC|a|Produced client Certificate handshake message (\n"certificate_list": [ ]\n)\n'
    )
    placed = tls.placed(tls.records(lines_of(spark, a=log)))
    got = {r.tid: r for r in tls.certificates(placed, tls.facts(placed)).collect()}
    assert (got["01"].client_cert_subject, got["01"].client_cert_cn, got["01"].authorities, got["01"].authorities_complete) == ('CN=\\"one, two\\", O=x', '"one', ["CN=A", "CN=B"], True)
    assert got["02"].client_cert_empty and got["02"].client_cert_subject is None and got["02"].authorities == []


def test_values_carried_over_buckets_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k in "abc" for i in range(1, 300)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    w = Window.partitionBy("k").orderBy("i")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("v")
    want = df.select("*", F.coalesce(F.sum(v).over(past), F.lit(0)).alias("s"), F.max(v).over(past).alias("m"), F.last(v, True).over(past).alias("p"), F.last(v, True).over(upto).alias("q"), F.lag(v, 2).over(w).alias("a"), F.lead(v).over(w).alias("z"))
    for width in (1, 7, 50, None):
        got = carry.carried(df, ["k"], carry.stretch("i", width), ["i"], s=carry.total(v, own=False), m=carry.largest(v, own=False), p=carry.latest(v, own=False), q=carry.latest(v))
        got = carry.beside(got, ["k"], "i", 2, width, a=(-2, v), z=(1, v))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [x.split("windowspecdefinition(")[1] for x in plan.split("\n") if "windowspecdefinition(" in x]
    assert windows and all("_bucket" in x.split("ASC")[0] for x in windows)


def test_snapshot_heads_of_every_form(spark):
    log = (
        "preamble\n2024-01-01T10:00:00.5+01:00\n77:\n2024-01-01 10:00:00\nFull thread dump A\nx\n"  # a collector's clock, from line 2
        "78:\n2024-01-01 10:00:01\nFull thread dump B\ny\n2024-01-01 10:00:02\nFull thread dump C\nz\nFull thread dump D\n2024-01-01 10:00:03\nnot a dump\n"
        "123\n2024-01-01T10:00:04Z\n21.0.1+12\nbody\n9:\nFull thread dump E\n"
    )
    for width in (None, 4, 5):
        got = {r.line_no: r.snapshot_index for r in threads.snapshots(lines_of(spark, a=log, b="no dump\nat all"), width).where("capture_id = 'a'").collect()}
        starts = [n for n in sorted(got) if n == 1 or got[n] != got[n - 1]]
        assert starts == [1, 7, 11, 14, 17, 22] and got[1] == 0 and got[22] == 5
    assert {r.snapshot_index for r in threads.snapshots(lines_of(spark, b="no dump\nat all")).collect()} == {0}


def test_generation_marks_do_not_hide_events(spark):
    log = (
        "[0.100s][info][gc,start] GC(0) Minor Collection (Allocation Rate)\n[0.110s][info][gc,phases] GC(0) Y: Pause Mark Start 0.012ms\n[0.120s][info][gc,phases] GC(0) Y: Concurrent Mark 8.000ms\n"
        "[0.130s][info][gc,phases] GC(0) O: Pause Mark End 0.020ms\n[0.140s][info][gc] GC(0) Minor Collection (Allocation Rate) 60M(30%)->20M(10%) 0.040s\n[0.150s][info][gc] GC(1) y: Allocation Stall (main) 2ms\n"
    )
    got = gc.events(lines_of(spark, a=log)).orderBy("end_line").collect()
    assert [(r.kind, r.duration_ms, r.line) for r in got] == [("pause", 0.012, 2), ("concurrent", 8.0, 3), ("pause", 0.02, 4), ("cycle", 40.0, 1), ("stall", 2.0, 6)]
    stats = gc.pause_stats(gc.events(lines_of(spark, a=log))).collect()[0]
    assert stats.pauses == 2 and abs(stats.total_pause_ms - 0.032) < 1e-9


def test_older_records_between_other_lines(spark):
    log = (
        "1.000: [GC concurrent-mark-start]\n2.000: [Full GC (System.gc()) 10K->5K(20K), 0.5 secs]\n3.000: [GC (Allocation Failure) [PSYoungGen: 1K->0K(2K)]\n3.100: [CMS-concurrent-mark: 0.1/0.2 secs]\n"
        "  4K->3K(9K), 0.25 secs]\n4.000: [CMS-concurrent-sweep: 0.1/0.75 secs]\nHeap\n garbage [0x1\n5.000: [GC concurrent-mark-end, 0.125 secs]\nmore\n6.000: [GC (Allocation Failure) 1K->1K(2K), 1 secs\n"
    )
    got = gc.events(lines_of(spark, a=log, b="[0.1s][info][gc] GC(0) Pause Young 1ms\n")).where("capture_id = 'a'").orderBy("line").collect()
    assert [(r.kind, r.line, r.end_line, r.duration_ms) for r in got] == [("pause", 2, 2, 500.0), ("pause", 3, 5, 250.0), ("concurrent", 6, 6, 750.0), ("concurrent", 9, 10, 125.0)]


def test_literals_in_a_long_text(spark):
    text = "ab" * 5 + ("x needle Y" * 20_000)
    got = generic.find_literal(spark.createDataFrame([(1, text), (2, "none"), (3, "NEEDLEneedle")], "i int, t string"), F.col("t"), "Needle").groupBy("i").agg(F.count("*").alias("n"), F.min("offset").alias("a"), F.max("offset").alias("z")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 20_000, 12, 12 + 19_999 * 10), (3, 2, 0, 6)]
