"""Queries of files, gates, JSON dumps, sinks, searches, orders and stack clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from capturelake.operators import clusters, evidence, generic, ordering, threads
from capturelake.plans import rendered
from capturelake.plans.catalogue import _DAY, _E, _FINDINGS, _GC, _checkpoints, _findings, _table, query
from capturelake.sources import captures, sinks


def _folder(spark) -> str:
    _checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


# --- files ---------------------------------------------------------------------


@query("s1_scan_files", "SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, CAST(0 AS BIGINT) AS rejected FROM documents WHERE text <> '' GROUP BY 1")
def s1_scan_files(spark, sf_dir):
    """The documents as text files by source, scanned again."""
    path = _folder(spark)
    _table(spark, sf_dir, "documents").where("text <> ''").select("source", "text").write.partitionBy("source").text(path)
    files = captures.scan(spark, path).withColumn("source", F.url_decode(F.regexp_extract("path", r"source=([^/]+)/", 1)))
    return files.groupBy("source").agg(F.sum("bytes").alias("bytes"), F.count("reason").alias("rejected"))


@query("s2_ingest_gate", "SELECT CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'compressed' WHEN 2 THEN 'binary' WHEN 3 THEN 'not UTF-8' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def s2_ingest_gate(spark, sf_dir):
    raw = F.coalesce("text", F.lit("")).cast("binary")
    kind = F.col("doc_id") % 5
    content = F.when(kind == 0, F.lit(b"")).when(kind == 1, F.concat(F.lit(b"\x1f\x8b"), raw)).when(kind == 2, F.concat(F.lit(b"a"), raw, F.lit(b"\x00"))).when(kind == 3, F.concat(F.lit(b"a"), raw, F.lit(b"\xff"))).otherwise(F.concat(F.lit(b"a"), raw))
    return _table(spark, sf_dir, "documents").groupBy(captures.gate(content).alias("reason")).agg(F.count("*").alias("n"))


@query("s3_duplicate_captures", "SELECT source || '/' || n_chars AS path, count(*) AS times, count(DISTINCT sha256(text)) > 1 AS conflict FROM documents GROUP BY 1 HAVING count(*) > 1")
def s3_duplicate_captures(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return captures.duplicates(docs.select(F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256")))


@query("s6_json_threads", f"WITH {_E} SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS capture_id, event_type AS container, event_type = 'error' AS incomplete, count(*) FILTER (WHERE event_id % 9 <> 4) AS valid, count(*) FILTER (WHERE event_id % 9 = 4) AS skipped FROM e GROUP BY ALL")
def s6_json_threads(spark, sf_dir):
    rows = captures.json_threads(rendered.json_dumps(_table(spark, sf_dir, "events")))
    return rows.groupBy("capture_id", "container", "incomplete").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("skipped"))


@query("s7_findings_sink", _GC + _FINDINGS + " SELECT capture_id, severity, count(*) AS n FROM f GROUP BY ALL")
def s7_findings_sink(spark, sf_dir):
    path = _folder(spark)
    sinks.write_findings(_findings(spark, sf_dir), path, ["capture_id", "severity", "rule", "line"])
    return spark.read.json(path).groupBy("capture_id", "severity").agg(F.count("*").alias("n"))


@query("t9_carriers", f"WITH {_E}, u AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS capture_id, user_id FROM e) SELECT capture_id, CAST(user_id + 100000 AS VARCHAR) AS jvm_id, user_id % 5 <> 0 AS linked FROM u")
def t9_carriers(spark, sf_dir):
    marked = threads.snapshots(rendered.lines(rendered.carrier_dumps(_table(spark, sf_dir, "events")), rendered.USERS))
    return threads.carriers(marked, threads.threads(marked)).select("capture_id", "jvm_id", F.col("virtual_line").isNotNull().alias("linked"))


# --- orders and unions -----------------------------------------------------------


@query("k1_null_rule_sort", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS INTEGER) AS place FROM orders")
def k1_null_rule_sort(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")))
    return ordering.placed_by(o, "o_custkey", [("price", True)], ["o_orderkey"], nulls_lowest=True).select("o_custkey", "o_orderkey", "place")


@query("u1_union_of_sources", f"WITH {_E} SELECT source, count(*) AS n FROM (SELECT 'gc' AS source FROM e UNION ALL SELECT 'tls' FROM e) GROUP BY 1")
def u1_union_of_sources(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    of = lambda rows, name: rows.select(F.lit(name).alias("source"), "line")
    both = of(rendered.gc_logs(events).where("part = 1"), "gc").unionByName(of(rendered.tls_logs(events), "tls"))
    return both.groupBy("source").agg(F.count("*").alias("n"))


@query("u2_distinct_first", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def u2_distinct_first(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("j19_availability", f"WITH {_E}, w AS (SELECT event_id, ['classic', 'plain', 'json', 'tls', 'heap'][event_id % 5 + 1] AS format, event_id % 30 AS version, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'hotspot' END AS vm FROM e), s AS (SELECT *, CASE WHEN format = 'heap' THEN 'unknown format' WHEN version < 7 OR version > 27 OR vm <> 'hotspot' THEN 'not established' WHEN format IN ('plain', 'json') AND version < 19 THEN 'not available' ELSE 'available' END AS status FROM w) SELECT event_id, status, CASE status WHEN 'available' THEN TRUE WHEN 'not available' THEN FALSE END AS available FROM s")
def j19_availability(spark, sf_dir):
    number = F.col("event_id")
    names = F.array(*map(F.lit, ("classic", "plain", "json", "tls", "heap")))
    wanted = _table(spark, sf_dir, "events").select("event_id", F.element_at(names, (number % 5 + 1).cast("int")).alias("format"), (number % 30).alias("version"), F.when(number % 11 == 0, "other").otherwise("hotspot").alias("vm"))
    return generic.availability(wanted, list(range(7, 28))).select("event_id", "status", "available")


# --- searches --------------------------------------------------------------------

_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"


@query("x1_weighted_search", f"WITH w AS (SELECT doc_id, lower(lang) AS t, {_WORDS.format('lang')} AS a, {_WORDS.format('source')} AS b, {_WORDS.format('text')} AS c FROM documents), s AS (SELECT doc_id, t, " + ", ".join(f"CASE WHEN len(list_filter(a, lambda x: {test})) > 0 THEN 8 WHEN len(list_filter(b, lambda x: {test})) > 0 THEN 4 WHEN len(list_filter(c, lambda x: {test})) > 0 THEN 1 END AS s{i}" for i, test in enumerate(("contains(x, 'licen')", "contains(x, 'src')", "x = '0'"))) + " FROM w) SELECT doc_id, CAST(s0 + s1 + s2 + CASE WHEN contains(t, 'licen src 0') THEN 100 ELSE 0 END AS INTEGER) AS score FROM s WHERE s0 + s1 + s2 IS NOT NULL")
def x1_weighted_search(spark, sf_dir):
    return generic.weighted_search(_table(spark, sf_dir, "documents"), "licen src 0", "doc_id", "lang", "source", "text")


def x2_match_ranges(spark, sf_dir):
    return generic.match_ranges(_table(spark, sf_dir, "documents"), "doc_id", "text", "the licensed 4 sed")


def x3_best_excerpt(spark, sf_dir):
    return generic.best_excerpt(_table(spark, sf_dir, "documents"), "doc_id", "text", "licensed under token")


def x3_section_excerpts(spark, sf_dir):
    """Lines of a document are its sections."""
    _checkpoints(spark)
    sections = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "line"))
    return generic.section_excerpts(sections, "doc_id", "section", "line", "licensed under token")


query("x3_section_excerpts")(x3_section_excerpts)
query("x2_match_ranges")(x2_match_ranges)
query("x3_best_excerpt")(x3_best_excerpt)


# --- similar stacks --------------------------------------------------------------


def _stacks(spark, sf_dir):
    """RUNNABLE threads of the months' dumps with their shapes, and the scored pairs of shapes."""
    _checkpoints(spark)
    marked = threads.snapshots(rendered.lines(rendered.trouble_dumps(_table(spark, sf_dir, "events"), "month"), rendered.USERS))
    rows = evidence.fingerprints(threads.threads(marked).where("java_state = 'RUNNABLE'")).withColumn("session", F.col("capture_id"))
    rows = rows.where(F.size("meaningful_frames") > 0).withColumn("shape", F.sha2(F.to_json("meaningful_frames"), 256)).checkpoint()
    scored = clusters.similarity(clusters.candidates(clusters.shapes(rows))).checkpoint()
    return rows, scored


@query("c1_stack_similarity")
def c1_stack_similarity(spark, sf_dir):
    return _stacks(spark, sf_dir)[1].select("session", "shape", "leader", "a", "b", "app_a", "app_b", F.round("score", 6).alias("score"), "method")


@query("c2_cluster_candidates", _DAY + ", s AS (SELECT DISTINCT left(capture_id, 7) AS session, CASE kind WHEN 'error' THEN 'app.Caller.call(Caller.java)' WHEN 'signup' THEN 'app.C' || user_id % 5 || '.<clinit>(C.java)' ELSE 'app.Handler' || m % 7 || '.run(Handler.java)' END AS top FROM t WHERE kind IN ('error', 'signup', 'view')) SELECT x.session, x.top, y.top AS leader_top FROM s x JOIN s y USING (session)")
def c2_cluster_candidates(spark, sf_dir):
    return _stacks(spark, sf_dir)[1].select("session", F.col("a")[0].alias("top"), F.col("b")[0].alias("leader_top"))


def _clusters(spark, sf_dir):
    rows, scored = _stacks(spark, sf_dir)
    named = rows.select("session", "shape", "start_line", "snapshot_index", F.col("start_line").alias("place"))
    found = clusters.leader_clusters(named, scored)
    return found.join(named.select("session", "place", F.col("snapshot_index").alias("snapshot")), ["session", "place"])


@query("c3_leader_clusters")
def c3_leader_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("session", "shape", "place", "leader_place", F.round("score", 6).alias("score"), "method")


@query("c4_cluster_summary")
def c4_cluster_summary(spark, sf_dir):
    return clusters.cluster_summary(_clusters(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6))


@query("p11_cluster_filter")
def p11_cluster_filter(spark, sf_dir):
    """Clusters seen in three snapshots at least whose counts persist."""
    members = _clusters(spark, sf_dir)
    places = members.select("session", F.col("snapshot").alias("snapshot")).distinct().withColumn("complete", F.lit(True))
    trend = evidence.count_trend(evidence.count_timeline(members, places, "session", "leader_place", "snapshot"), "snapshot", "session", "leader_place")
    return clusters.cluster_summary(members).join(trend, ["session", "leader_place"]).where("snapshots >= 3 AND trend IN ('Persistent', 'Growing', 'Fading', 'Stable')").select("session", "leader_place", "snapshots", "trend")
