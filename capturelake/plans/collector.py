"""Queries of JVM segments, older records, clocks, warnings and signals of collector logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import gc, generic
from capturelake.plans import rendered
from capturelake.plans.catalogue import _E, _GC, _checkpoints, _gc_lines, _table, _us, query

_V = (
    f"WITH RECURSIVE {_E}, v AS (SELECT user_id, event_id AS id, event_type AS kind, us, 2 AS part, us AS t, TRUE AS counts, FALSE AS closes FROM e UNION ALL SELECT user_id, event_id, event_type, greatest(0, us - n), 0, greatest(0, us - n), FALSE, FALSE FROM e WHERE event_type = 'click'"
    " UNION ALL SELECT user_id, event_id, event_type, greatest(0, us - n // 2), 1, greatest(0, us - n // 2), FALSE, FALSE FROM e WHERE event_type = 'click' AND event_id % 2 = 0 UNION ALL SELECT user_id, event_id, event_type, us, 1, us, FALSE, TRUE FROM e WHERE event_type = 'signup')"
    f", o AS (SELECT * REPLACE (t % {rendered.WEEK_US} AS t), row_number() OVER (PARTITION BY user_id ORDER BY us, part) AS line FROM v)"
    ", s AS (SELECT user_id, line, 0 AS session, t AS hi, counts AS had FROM o WHERE line = 1 UNION ALL SELECT o.user_id, o.line, s.session + CASE WHEN o.t < s.hi - 1000000 OR o.closes AND s.had THEN 1 ELSE 0 END, CASE WHEN o.t < s.hi - 1000000 OR o.closes AND s.had THEN o.t ELSE greatest(s.hi, o.t) END, CASE WHEN o.t < s.hi - 1000000 OR o.closes AND s.had THEN o.counts ELSE s.had OR o.counts END FROM s JOIN o ON o.user_id = s.user_id AND o.line = s.line + 1)"
    ", p AS (SELECT CAST(o.user_id AS VARCHAR) AS capture_id, o.*, s.session FROM o JOIN s USING (user_id, line))"
)


def _lines(spark, sf_dir):
    return generic.cut(rendered.lines(rendered.collector_logs(_table(spark, sf_dir, "events"))))


def _told(spark, sf_dir):
    """The lines, what they tell and their segments, each written once."""
    _checkpoints(spark)
    lines = _lines(spark, sf_dir)
    told = generic.cut(gc.read(lines))
    return lines, told, generic.cut(gc.session_lines(lines, told))


def _placed(spark, sf_dir):
    return _told(spark, sf_dir)[2]


@query("w11_gc_sessions", _V + " SELECT capture_id, CAST(session AS INTEGER) AS session, CAST(min(line) AS INTEGER) AS first_line, CAST(max(line) AS INTEGER) AS last_line, min(t) AS from_us, max(t) AS to_us, count(*) FILTER (WHERE counts) AS records FROM p GROUP BY ALL HAVING count(*) FILTER (WHERE counts) > 0")
def w11_gc_sessions(spark, sf_dir):
    return gc.sessions(_placed(spark, sf_dir)).select("capture_id", "session", "first_line", "last_line", _us("from_ms").alias("from_us"), _us("to_ms").alias("to_us"), "records")


@query("e6_gc_collectors", _V + " SELECT capture_id, CAST(session AS INTEGER) AS session, coalesce(arg_max(CASE WHEN closes THEN CASE WHEN id % 2 = 0 THEN 'G1' ELSE 'Parallel' END END, line), 'Unknown') AS collector FROM p GROUP BY ALL HAVING count(*) FILTER (WHERE counts) > 0")
def e6_gc_collectors(spark, sf_dir):
    return gc.sessions(_placed(spark, sf_dir)).select("capture_id", "session", "collector")


@query("e7_gc_session_events", _V + ", a AS (SELECT * FROM p WHERE kind = 'click' AND part = 0), z AS (SELECT * FROM p WHERE part = 2) SELECT z.capture_id, CAST(z.session AS INTEGER) AS session, z.id AS gc_id, CAST(coalesce(a.line, z.line) AS INTEGER) AS line, CAST(z.line AS INTEGER) AS end_line FROM z LEFT JOIN a ON a.user_id = z.user_id AND a.id = z.id AND a.session = z.session")
def e7_gc_session_events(spark, sf_dir):
    lines, told, placed = _told(spark, sf_dir)
    return gc.events(lines, placed, told).select("capture_id", "session", "gc_id", "line", "end_line")


@query("e9_gc_warnings", _V + ", a AS (SELECT p.user_id, count(*) AS open_starts FROM p JOIN p z ON z.user_id = p.user_id AND z.id = p.id AND z.part = 2 WHERE p.kind = 'click' AND p.part = 0 AND z.session <> p.session GROUP BY 1), n AS (SELECT capture_id, user_id, count(DISTINCT session) FILTER (WHERE counts) AS segments FROM p GROUP BY ALL) SELECT capture_id, segments, coalesce(open_starts, 0) AS open_starts, concat_ws(', ', CASE WHEN segments > 1 THEN 'several segments' END, CASE WHEN open_starts > 0 THEN 'start without completion' END) AS warnings FROM n LEFT JOIN a USING (user_id)")
def e9_gc_warnings(spark, sf_dir):
    lines, told, placed = _told(spark, sf_dir)
    return gc.warnings(lines, placed, told).withColumn("warnings", F.array_join("warnings", ", "))


@query("e1_gc_records", _V + " SELECT capture_id, kind = 'click' AND part = 0 AS is_start, count(*) AS n, count(*) FILTER (WHERE part = 2 OR kind = 'click') AS with_id FROM p GROUP BY ALL")
def e1_gc_records(spark, sf_dir):
    return gc.records(_lines(spark, sf_dir)).groupBy("capture_id", "is_start").agg(F.count("*").alias("n"), F.count("gc_id").alias("with_id"))


@query("e2_gc_clocks", _V + " SELECT capture_id, 'uptime' AS clock, t AS clock_us, count(*) AS n FROM p GROUP BY ALL")
def e2_gc_clocks(spark, sf_dir):
    return gc.records(_lines(spark, sf_dir)).groupBy("capture_id", "clock", _us("clock_ms").alias("clock_us")).agg(F.count("*").alias("n"))


@query("e4_gc_event_kinds", _V + " SELECT CASE kind WHEN 'error' THEN 'stall' WHEN 'click' THEN 'cycle' ELSE 'pause' END AS kind, kind = 'purchase' AS \"full\", kind = 'purchase' AS explicit, count(*) AS n FROM p WHERE part = 2 GROUP BY ALL")
def e4_gc_event_kinds(spark, sf_dir):
    return gc.events(_lines(spark, sf_dir)).groupBy("kind", "full", "explicit").agg(F.count("*").alias("n"))


@query("e10_gc_signal_meanings", _V + " SELECT CASE WHEN kind = 'error' THEN 'Allocation stall' ELSE 'Evacuation failure reported' END AS meaning, kind = 'error' AS critical, count(*) AS n FROM p WHERE kind = 'error' OR kind = 'click' AND part = 1 GROUP BY ALL")
def e10_gc_signal_meanings(spark, sf_dir):
    return gc.explained(gc.signals(_lines(spark, sf_dir))).groupBy("meaning", "critical").agg(F.count("*").alias("n"))


@query("j15_signal_events", _V + ", x AS (SELECT capture_id, line, id, CASE WHEN kind = 'error' THEN 0 ELSE 1 END AS how FROM p WHERE kind = 'error' OR kind = 'click' AND part = 1) SELECT capture_id, CAST(x.line AS INTEGER) AS line, how, CAST(z.line AS INTEGER) AS event_line FROM x JOIN p z USING (capture_id, id) WHERE z.part = CASE how WHEN 0 THEN 2 ELSE 0 END")
def j15_signal_events(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return gc.signal_events(generic.cut(gc.events(lines)), generic.cut(gc.signals(lines))).select("capture_id", "line", "how", "event_line")


@query("j16_gc_start_lines", _V + ", a AS (SELECT * FROM p WHERE kind = 'click' AND part = 0) SELECT capture_id, id AS gc_id, CAST(a.line AS INTEGER) AS line, CAST(z.line AS INTEGER) AS end_line FROM a JOIN p z USING (capture_id, id) WHERE z.part = 2")
def j16_gc_start_lines(spark, sf_dir):
    return gc.events(_lines(spark, sf_dir)).where("line < end_line").select("capture_id", "gc_id", "line", "end_line")


@query("e3_legacy_records", f"WITH {_E} SELECT CAST(user_id AS VARCHAR) AS capture_id, n AS duration_us, us AS start_us, us + n AS end_us, event_id % 500 + 5 AS before_kb, event_id % 97 + 4 AS after_kb, 6000 AS capacity_kb, TRUE AS \"full\", TRUE AS explicit FROM e WHERE event_type = 'purchase' AND event_id % 10 <> 3")
def e3_legacy_records(spark, sf_dir):
    kb = lambda c: (F.col(c) / 1024).cast("long")
    e = gc.events(generic.cut(rendered.lines(rendered.legacy_logs(_table(spark, sf_dir, "events")))))
    return e.select("capture_id", _us("duration_ms").alias("duration_us"), _us("start_ms").alias("start_us"), _us("end_ms").alias("end_us"), kb("heap_before").alias("before_kb"), kb("heap_after").alias("after_kb"), kb("heap_capacity").cast("int").alias("capacity_kb"), "full", "explicit")


@query("w10_pause_share", _GC + ", p AS (SELECT *, max(end_us) OVER (PARTITION BY capture_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g WHERE kind = 'pause'), u AS (SELECT capture_id, sum(greatest(0, end_us - greatest(start_us, coalesce(reach, start_us)))) AS covered FROM p GROUP BY 1), w AS (SELECT capture_id, max(end_us) - min(start_us) AS seen FROM g GROUP BY 1) SELECT capture_id, round(least(100.0::DOUBLE, coalesce(covered, 0) * 100.0::DOUBLE / seen), 6) AS share FROM w LEFT JOIN u USING (capture_id) WHERE seen > 0")
def w10_pause_share(spark, sf_dir):
    return gc.pause_stats(generic.cut(gc.events(_gc_lines(spark, sf_dir)))).where("pause_share IS NOT NULL").select("capture_id", F.round("pause_share", 6).alias("share"))
