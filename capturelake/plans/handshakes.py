"""Queries of handshake facts, sequences, facets and searches over rendered debug logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import generic, tls
from capturelake.plans import rendered
from capturelake.plans.catalogue import _E, _JAN, BASE_US, _table, query

_FACTS = (
    f"WITH {_E}, r AS (SELECT CAST(user_id % 20 AS VARCHAR) AS capture_id, lower(printf('%x', user_id)) AS tid, user_id, event_id AS id, event_type AS kind, us, CASE WHEN event_id % 50 <> 7 THEN (us + {BASE_US}) // 1000 END AS ms, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS hello_no FROM e)"
    ", st AS (SELECT user_id, hello_no, bool_or(kind = 'click' AND id % 4 = 0) AS retry, bool_or(kind = 'purchase' OR kind = 'error' AND id % 3 = 0) AS closed FROM r GROUP BY ALL)"
    ", op AS (SELECT user_id, hello_no, sum(CASE WHEN hello_no > 0 AND NOT coalesce(answered, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY hello_no) AS interaction FROM (SELECT *, lag(CASE WHEN hello_no > 0 THEN retry AND NOT closed END) OVER (PARTITION BY user_id ORDER BY hello_no) AS answered FROM st))"
    ", p AS (SELECT r.*, CAST(interaction AS BIGINT) AS interaction FROM r JOIN op USING (user_id, hello_no))"
    ", x AS (SELECT capture_id, tid, user_id, interaction, CASE WHEN bool_or(kind = 'view' AND id % 3 = 0) THEN 'TLSv1.3' WHEN bool_or(kind = 'view') THEN 'TLSv1.2' END AS tls_version, 'TLS_C' || (arg_max(id, us) FILTER (WHERE kind = 'view')) % 5 AS cipher_suite, bool_or(kind = 'signup') AS hello, count(*) FILTER (WHERE kind = 'view') AS server_hellos, count(*) FILTER (WHERE kind = 'purchase' AND id % 2 = 0) AS sent, count(*) FILTER (WHERE kind = 'purchase' AND id % 2 = 1) AS met, CASE WHEN bool_or(kind = 'error' AND id % 3 = 1) THEN 'alert_bad_certificate' WHEN bool_or(kind = 'error' AND id % 3 = 0) THEN 'local_fatal_alert' END AS failure_key, min(ms) AS start_ms, max(ms) AS end_ms, bool_or(ms IS NULL) AS no_clock, count(*) AS records FROM p GROUP BY ALL)"
    ", y AS (SELECT *, sent > 0 AND met > 0 AS done, hello AND NOT (sent > 0 AND met > 0) AND failure_key IS NULL AND lead(interaction) OVER (PARTITION BY user_id ORDER BY interaction) IS NOT NULL AS hanging FROM x)"
    ", z AS (SELECT *, server_hellos > 1 OR sent > 1 OR met > 1 OR bool_or(hanging) OVER (PARTITION BY user_id ORDER BY interaction) AS ambiguous FROM y)"
    ", f AS (SELECT capture_id, tid, interaction, CASE WHEN ambiguous THEN 'unknown' WHEN failure_key IS NOT NULL THEN 'failure' WHEN done THEN 'success' ELSE 'unknown' END AS outcome, CASE WHEN NOT ambiguous AND hello THEN 'outbound' ELSE 'unknown' END AS direction, CASE WHEN NOT ambiguous THEN tls_version END AS tls_version, CASE WHEN NOT ambiguous THEN cipher_suite END AS cipher_suite, CASE WHEN NOT ambiguous AND hello THEN 'Host-' || user_id % 7 || '.example' END AS sni, CASE WHEN NOT ambiguous THEN failure_key END AS failure_key, ambiguous, CASE WHEN no_clock THEN 'unavailable' ELSE 'reliable' END AS time_quality, CASE WHEN NOT no_clock THEN end_ms - start_ms END AS duration_ms, start_ms, end_ms, records FROM z)"
)
_ENTRIES = _FACTS + ", n AS (SELECT capture_id, tid, interaction, lower(concat_ws(' | ', outcome, direction, tid, sni, sni, tls_version, cipher_suite, failure_key)) AS search, lower(sni) AS host, lower(sni) AS sni, CASE WHEN outcome = 'failure' THEN coalesce(failure_key, 'other') END AS failure, outcome, direction, CASE WHEN time_quality = 'reliable' THEN start_ms END AS start_ms, CASE WHEN time_quality = 'reliable' THEN end_ms END AS end_ms FROM f)"


def _records(spark, sf_dir):
    return generic.cut(tls.records(generic.cut(rendered.lines(rendered.handshakes(_table(spark, sf_dir, "events"))))))


def _placed(spark, sf_dir):
    return tls.placed(_records(spark, sf_dir))


def _facts(spark, sf_dir):
    return tls.facts(_placed(spark, sf_dir))


def _entries(spark, sf_dir):
    return tls.prepared(_facts(spark, sf_dir))


@query("l2_zoned_times", _FACTS + " SELECT capture_id, tid, ms AS epoch_ms, count(*) AS n FROM r GROUP BY ALL")
def l2_zoned_times(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("capture_id", "tid", "epoch_ms").agg(F.count("*").alias("n"))


@query("l3_retried_hellos", _FACTS + " SELECT capture_id, tid, interaction, count(*) AS records FROM p GROUP BY ALL")
def l3_retried_hellos(spark, sf_dir):
    return _placed(spark, sf_dir).groupBy("capture_id", "tid", "interaction").agg(F.count("*").alias("records"))


@query("l4_tls_facts", _FACTS + " SELECT *, sni AS peer_host FROM f")
def l4_tls_facts(spark, sf_dir):
    return _facts(spark, sf_dir)


@query("l8_ambiguous_handshakes", _FACTS + " SELECT capture_id, tid, count(*) AS interactions, count(*) FILTER (WHERE ambiguous) AS ambiguous FROM f GROUP BY ALL")
def l8_ambiguous_handshakes(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("capture_id", "tid").agg(F.count("*").alias("interactions"), F.count_if("ambiguous").alias("ambiguous"))


@query("l7_tls_alerts", f"WITH {_E} SELECT CAST(user_id % 20 AS VARCHAR) AS capture_id, CASE event_id % 3 WHEN 1 THEN 'fatal' ELSE 'warning' END AS level, CASE event_id % 3 WHEN 1 THEN 'bad_certificate' ELSE 'close_notify' END AS description, 'Received' AS origin, event_id % 3 = 1 AS failure, count(*) AS n FROM e WHERE event_type = 'error' AND event_id % 3 <> 0 GROUP BY ALL")
def l7_tls_alerts(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return rows.select("capture_id", tls.alert(F.col("message"), F.col("body"), F.lit("TLSv1.2")).alias("a")).where("a IS NOT NULL").groupBy("capture_id", "a.level", "a.description", "a.origin", "a.failure").agg(F.count("*").alias("n"))


_SEQUENCE = ", q AS (SELECT p.*, f.ambiguous, coalesce(bool_or(kind = 'purchase' AND id % 2 = 0) OVER w AND bool_or(kind = 'purchase' AND id % 2 = 1) OVER w, FALSE) AS late FROM p JOIN f USING (capture_id, tid, interaction) WINDOW w AS (PARTITION BY p.user_id, p.interaction ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s AS (SELECT *, CASE WHEN kind = 'signup' THEN ['ClientHello', 'Produced', 'handshake'] WHEN kind = 'view' THEN ['ServerHello', 'Consumed', 'handshake'] WHEN kind = 'purchase' THEN CASE WHEN id % 2 = 0 THEN ['client Finished', 'Produced', 'handshake'] ELSE ['server Finished', 'Consumed', 'handshake'] END WHEN kind = 'click' AND id % 4 = 0 THEN ['HelloRetryRequest', 'Consumed', 'handshake'] WHEN kind = 'error' THEN CASE id % 3 WHEN 0 THEN ['local_fatal_alert', 'Diagnostic', 'failure'] WHEN 1 THEN ['Fatal alert: bad_certificate', 'Received', 'failure'] ELSE ['Alert: close_notify', 'Received', 'alert'] END END AS v FROM q)"


@query("l12_tls_sequence", _FACTS + _SEQUENCE + " SELECT capture_id, tid, interaction, CAST(row_number() OVER (PARTITION BY user_id, interaction ORDER BY us) AS INTEGER) AS event_no, v[1] AS title, v[2] AS action, v[3] AS kind, late AND NOT ambiguous AS post_handshake FROM s WHERE v IS NOT NULL")
def l12_tls_sequence(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    return tls.sequence(rows, tls.facts(rows)).select("capture_id", "tid", "interaction", "event_no", "title", "action", "kind", "post_handshake")


@query("w14_completed_handshakes", _FACTS + _SEQUENCE + " SELECT capture_id, count(*) FILTER (WHERE NOT late) AS during, count(*) FILTER (WHERE late AND NOT ambiguous) AS after FROM s WHERE v IS NOT NULL GROUP BY 1")
def w14_completed_handshakes(spark, sf_dir):
    rows = _placed(spark, sf_dir)
    of = tls.facts(rows)
    seen = tls.sequence(rows, of.withColumn("ambiguous", F.lit(False))).groupBy("capture_id").agg(F.count_if(~F.col("post_handshake")).alias("during"))
    return seen.join(tls.sequence(rows, of).groupBy("capture_id").agg(F.count_if("post_handshake").alias("after")), "capture_id")


#: A small catalogue of issue words: tier (0 specific, 1 alert names, 2 fallback), words, key.
ISSUES = [(0, "local_fatal_alert", "local-fatal"), (1, "bad_certificate", "bad_certificate"), (1, "alert_bad_certificate", "peer-rejected-certificate"), (2, "alert", "fatal-alert")]


@query("l10_issue_keys", _FACTS + " SELECT CASE failure_key WHEN 'local_fatal_alert' THEN 'local-fatal' ELSE 'peer-rejected-certificate' END AS issue, count(*) AS n FROM f WHERE outcome = 'failure' GROUP BY 1")
def l10_issue_keys(spark, sf_dir):
    failed = _facts(spark, sf_dir).where("outcome = 'failure'")
    return failed.groupBy(tls.issue_key(F.col("failure_key"), ISSUES).alias("issue")).agg(F.count("*").alias("n"))


@query("l11_prepared_entries", _ENTRIES + " SELECT * FROM n")
def l11_prepared_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


_PERIOD = (_JAN[0] + 432_000_000, _JAN[0] + 1_728_000_000)
_WHERE = {
    "search": "contains(search, 'tls_c')",
    "outcome": "outcome = 'failure'",
    "host": "host IN ('host-1.example', 'host-2.example', 'host-3.example')",
    "failure": "failure IN ('local_fatal_alert', 'alert_bad_certificate')",
    "period": f"start_ms < {_PERIOD[1]} AND end_ms >= {_PERIOD[0]}",
}
_FILTERS = {"search": "TLS_C", "outcome": "failure", "hosts": ("host-1.example", "host-2.example", "host-3.example"), "failures": ("local_fatal_alert", "alert_bad_certificate"), "period": _PERIOD}


@query("p5_tls_entry_filter", _ENTRIES + f" SELECT capture_id, tid, interaction FROM n WHERE {' AND '.join(_WHERE.values())}")
def p5_tls_entry_filter(spark, sf_dir):
    return tls.select_entries(_entries(spark, sf_dir), **_FILTERS).select("capture_id", "tid", "interaction")


def _facet_sql(field):
    others = " AND ".join(v for k, v in _WHERE.items() if k != field)
    return f"SELECT '{field}' AS field, v.value, count(c.value) AS n FROM (SELECT DISTINCT {field} AS value FROM n WHERE {field} IS NOT NULL) v LEFT JOIN (SELECT {field} AS value FROM n WHERE {others}) c ON c.value = v.value GROUP BY ALL"


@query("a20_self_excluding_facets", _ENTRIES + " " + " UNION ALL ".join(map(_facet_sql, ("host", "sni", "failure"))))
def a20_self_excluding_facets(spark, sf_dir):
    return tls.facets(_entries(spark, sf_dir), **_FILTERS)


@query("k2_sorted_interactions", _FACTS + " SELECT capture_id, tid, interaction, CAST(row_number() OVER (PARTITION BY capture_id ORDER BY start_ms DESC NULLS LAST, tid, interaction) AS INTEGER) AS place FROM f")
def k2_sorted_interactions(spark, sf_dir):
    from capturelake.operators.ordering import placed_by

    return placed_by(_facts(spark, sf_dir), "capture_id", [("start_ms", True)], ["tid", "interaction"]).select("capture_id", "tid", "interaction", "place")


@query("l13_oracle_check", _FACTS + " SELECT capture_id, tid, interaction, CASE WHEN outcome <> 'success' AND tls_version IS DISTINCT FROM 'TLSv1.3' THEN 'outcome,tls_version' WHEN outcome <> 'success' THEN 'outcome' ELSE 'tls_version' END AS wrong FROM f WHERE outcome <> 'success' OR tls_version IS DISTINCT FROM 'TLSv1.3'")
def l13_oracle_check(spark, sf_dir):
    of = _facts(spark, sf_dir)
    expected = of.select("capture_id", "tid", "interaction", F.lit("success").alias("outcome"), F.lit("TLSv1.3").alias("tls_version"))
    return tls.unexpected(of, expected, "outcome", "tls_version").withColumn("wrong", F.array_join("wrong", ","))


# --- logs in three formats, and certificates --------------------------------------------

_MIXED = f"WITH {_E}, r AS (SELECT CAST(user_id AS VARCHAR) AS capture_id, lower(printf('%x', user_id)) AS tid, user_id, event_id AS id, event_type AS kind, us, (us + {BASE_US}) // 1000 AS ms FROM e)"


def _mixed(spark, sf_dir):
    return generic.cut(tls.records(generic.cut(rendered.lines(rendered.mixed_handshakes(_table(spark, sf_dir, "events"))))))


@query(
    "l1_mixed_records",
    _MIXED + ", v AS (SELECT capture_id, CASE WHEN kind = 'view' THEN 'expanded' ELSE 'compact' END AS format, tid, 'worker' AS thread, ms AS epoch_ms, CASE kind WHEN 'signup' THEN 'Produced ClientHello handshake message (' WHEN 'view' THEN 'Ignore unavailable extension' WHEN 'click' THEN 'Consuming CertificateRequest handshake message (' ELSE 'Produced client Certificate handshake message (' END AS message, CASE kind WHEN 'view' THEN 9 WHEN 'click' THEN 5 ELSE 4 END AS line_count FROM r WHERE kind <> 'purchase'"
    " UNION ALL SELECT capture_id, 'legacy', 'legacy', 'main', NULL, 'main, ' || CASE WHEN id % 2 = 0 THEN 'READ' ELSE 'WRITE' END || ': TLSv1.2 Handshake, length = 9', 1 FROM r WHERE kind = 'purchase'"
    " UNION ALL SELECT capture_id, 'legacy', 'legacy', 'main', NULL, CASE WHEN id % 2 = 0 THEN 'Consuming' ELSE 'Produced' END || ' Finished handshake message', CASE WHEN id % 3 = 0 THEN 3 ELSE 1 END FROM r WHERE kind = 'purchase') SELECT * FROM v",
)
def l1_mixed_records(spark, sf_dir):
    return _mixed(spark, sf_dir).select("capture_id", "format", "tid", "thread", "epoch_ms", "message", "line_count")


_Q = '\\"'  # as logs print a quote inside a quoted name


@query(
    "l4_certificate_facts",
    _MIXED + ", i AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS interaction FROM r WHERE kind <> 'purchase'), a AS (SELECT capture_id, tid, interaction, bool_or(kind = 'signup') AS hello, arg_min(id % 5, us) FILTER (WHERE kind = 'error') AS client, coalesce(bool_or(kind = 'click'), FALSE) AS asked FROM i GROUP BY ALL)"
    ", h AS (SELECT *, hello AND lead(interaction) OVER (PARTITION BY capture_id ORDER BY interaction) IS NOT NULL AS hanging FROM a), k AS (SELECT *, bool_or(hanging) OVER (PARTITION BY capture_id ORDER BY interaction) AS ambiguous FROM h)"
    f", c AS (SELECT capture_id, interaction, unnest(['CN=[root ' || id % 3 || '], O={_Q}x{_Q}', 'CN=Common\\, Root']) AS name, us * 10 + unnest([0, 1]) AS place FROM i WHERE kind = 'click'), n AS (SELECT capture_id, interaction, string_agg(name, '|' ORDER BY place) AS names FROM (SELECT capture_id, interaction, name, min(place) AS place FROM c GROUP BY ALL) GROUP BY ALL)"
    f" SELECT k.capture_id, tid, CAST(k.interaction AS BIGINT) AS interaction, CASE WHEN NOT ambiguous THEN 'O=a, CN={_Q}client, ' || client || '{_Q}, C=SE' END AS client_cert_subject, CASE WHEN NOT ambiguous AND client IS NOT NULL THEN '\"client' END AS client_cert_cn, CASE WHEN NOT ambiguous THEN coalesce(names, '') END AS authorities, CASE WHEN NOT ambiguous THEN asked END AS authorities_complete FROM k LEFT JOIN n USING (capture_id, interaction)",
)
def l4_certificate_facts(spark, sf_dir):
    placed = tls.placed(_mixed(spark, sf_dir)).where("format <> 'legacy'")
    found = tls.certificates(placed, tls.facts(placed))
    return found.select("capture_id", "tid", "interaction", "client_cert_subject", "client_cert_cn", F.array_join("authorities", "|").alias("authorities"), "authorities_complete")
