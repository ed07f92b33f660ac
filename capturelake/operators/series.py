"""Threads across the snapshots of a session: identity, series, changes and rates.

Rows are threads (operators.threads.threads) with `session` and `snapshot`, the snapshot's place in its session from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators import generic

_NODE = ["session", "snapshot", "source_key"]


def in_sessions(threads_: DataFrame, session) -> DataFrame:
    """Rows with session and snapshot; only one row a snapshot is ordered, by capture and place in it."""
    rows = threads_.withColumn("session", session)
    order = Window.partitionBy("session").orderBy("capture_id", "snapshot_index")
    places = rows.select("session", "capture_id", "snapshot_index").distinct().withColumn("snapshot", F.row_number().over(order))
    return rows.join(places, ["session", "capture_id", "snapshot_index"])


def source_keys(threads_: DataFrame) -> DataFrame:
    """source_key: tid, else the JVM's id, else nid, else the ordinal; a repeated key gets `:source:n` in line order."""
    keys = ["capture_id", "snapshot_index"]
    base = F.coalesce("tid", "jvm_id", "nid", F.concat(F.lit("line-"), F.col("start_line").cast("string")))
    same = Window.partitionBy(*keys, "_base")
    n = F.row_number().over(same.orderBy("start_line"))
    named = threads_.withColumn("_base", base).withColumn("_times", F.count("*").over(same)).withColumn("_n", n)
    return named.withColumn("source_key", F.when(F.col("_times") > 1, F.concat("_base", F.lit(":source:"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_times", "_n")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs of adjacent snapshots with an equal tid, JVM id, or nid and name; `fits` is false on another id or less elapsed time."""
    kept = ["tid", "jvm_id", "nid", "thread_name", "elapsed_s"]
    now = rows.select(*_NODE, *kept)
    before = rows.select(F.col("session").alias("before_session"), (F.col("snapshot") + 1).alias("next_snapshot"), *[F.col(c).alias(f"before_{c}") for c in ("source_key", *kept)])
    adjacent = (F.col("session") == F.col("before_session")) & (F.col("snapshot") == F.col("next_snapshot"))
    tried = [now.join(before, adjacent & F.expr(same)) for same in ("tid = before_tid", "jvm_id = before_jvm_id", "nid = before_nid AND thread_name = before_thread_name")]
    pairs = tried[0].unionByName(tried[1]).unionByName(tried[2]).dropDuplicates([*_NODE, "before_source_key"])
    agrees = [F.coalesce(F.col(c) == F.col(f"before_{c}"), F.lit(True)) for c in ("tid", "jvm_id", "nid")]
    fits = agrees[0] & agrees[1] & agrees[2] & F.coalesce(F.col("elapsed_s") >= F.col("before_elapsed_s"), F.lit(True))
    return pairs.select(*_NODE, "before_source_key", fits.alias("fits"))


def links(pairs: DataFrame) -> DataFrame:
    """Of candidates, the fitting ones whose two ends have no other fitting partner."""
    fit = pairs.where("fits")
    alone = lambda *key: F.count("*").over(Window.partitionBy("session", "snapshot", *key))
    return fit.withColumn("_a", alone("source_key")).withColumn("_b", alone("before_source_key")).where("_a = 1 AND _b = 1").select(*_NODE, "before_source_key")


def series(rows: DataFrame, accepted: DataFrame, rounds: int = 40) -> DataFrame:
    """Rows with first_snapshot and first_key of their chain of links, found by doubling steps; each round is written."""
    at = F.struct(F.col("snapshot"), F.col("source_key"))
    own = rows.select(*_NODE).join(accepted, _NODE, "left")
    ahead = F.when(F.col("before_source_key").isNotNull(), F.struct((F.col("snapshot") - 1).alias("snapshot"), F.col("before_source_key").alias("source_key"))).otherwise(at)
    state = generic.cut(own.select("session", at.alias("node"), ahead.alias("root")))
    for _ in range(rounds):
        step = state.select("session", F.col("node").alias("root"), F.col("root").alias("next"))
        new = generic.cut(state.join(step, ["session", "root"]).select("session", "node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").take(1):
            break
    else:
        raise ValueError(f"a series is longer than 2 ** {rounds} links")
    roots = state.select("session", "node.snapshot", "node.source_key", F.col("root.snapshot").alias("first_snapshot"), F.col("root.source_key").alias("first_key"))
    return rows.join(roots, _NODE)


def change_status(rows: DataFrame, pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per thread: baseline, continued, unresolved (candidates, none accepted) or new."""
    tried = pairs.select(*_NODE).distinct().withColumn("tried", F.lit(True))
    met = rows.join(accepted.select(*_NODE).withColumn("linked", F.lit(True)), _NODE, "left").join(tried, _NODE, "left")
    return met.withColumn("change", F.when(F.col("snapshot") == 1, "baseline").when(F.col("linked"), "continued").when(F.col("tried"), "unresolved").otherwise("new")).drop("linked", "tried")


def change_counts(rows: DataFrame, pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per snapshot: counts of each status, and of ended threads, unknown (null) where any thread is unresolved."""
    is_ = lambda s: F.count_if(F.col("change") == s).alias(s)
    counts = change_status(rows, pairs, accepted).groupBy("session", "snapshot").agg(is_("baseline"), is_("continued"), is_("unresolved"), is_("new"))
    before = rows.select("session", (F.col("snapshot") + 1).alias("snapshot"), F.col("source_key").alias("before_source_key"))
    gone = before.join(accepted, ["session", "snapshot", "before_source_key"], "left_anti").groupBy("session", "snapshot").agg(F.count("*").alias("gone"))
    ended = F.when(F.col("unresolved") == 0, F.coalesce("gone", F.lit(0)))
    return counts.join(gone, ["session", "snapshot"], "left").withColumn("ended", F.when(F.col("snapshot") > 1, ended)).drop("gone")


def with_before(rows: DataFrame, accepted: DataFrame, *columns: str) -> DataFrame:
    """Linked rows with the columns of the row before as before_*."""
    before = rows.select("session", (F.col("snapshot") + 1).alias("snapshot"), F.col("source_key").alias("before_source_key"), *[F.col(c).alias(f"before_{c}") for c in columns])
    return rows.join(accepted, _NODE).join(before, ["session", "snapshot", "before_source_key"])


def material_changes(rows: DataFrame, accepted: DataFrame, cpu_ms: float) -> DataFrame:
    """One row per linked thread and kind of change: name, state, top-frame, waiting-locks, held-locks, cpu-activity.

    `rows` also hold top_method (normalized), waiting_locks and held_locks (sorted arrays).
    """
    both = with_before(rows, accepted, "thread_name", "java_state", "top_method", "waiting_locks", "held_locks", "cpu_ms")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"before_{c}"))
    kinds = {"name": differs("thread_name"), "state": differs("java_state"), "top-frame": differs("top_method"), "waiting-locks": differs("waiting_locks"), "held-locks": differs("held_locks"), "cpu-activity": F.col("cpu_ms") - F.col("before_cpu_ms") >= cpu_ms}
    return both.select(*_NODE, F.explode(F.array_compact(F.array(*[F.when(test, F.lit(kind)) for kind, test in kinds.items()]))).alias("change"))


def cpu_rates(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Linked rows whose counter did not fall: delta_ms, interval_ms (of epoch_ms) and percent, rounded to 6 places."""
    both = with_before(rows, accepted, "cpu_ms", "epoch_ms")
    moved = both.withColumn("delta_ms", F.col("cpu_ms") - F.col("before_cpu_ms")).withColumn("interval_ms", F.col("epoch_ms") - F.col("before_epoch_ms"))
    return moved.where("delta_ms >= 0 AND interval_ms > 0").withColumn("percent", F.round(F.col("delta_ms") * 100 / F.col("interval_ms"), 6))


def series_totals(rates: DataFrame, *key: str) -> DataFrame:
    """Interval-weighted mean rate and number of samples."""
    return rates.groupBy(*key).agg(F.sum("delta_ms").alias("delta_ms"), F.sum("interval_ms").alias("interval_ms"), F.count("*").alias("samples")).withColumn("percent", F.round(F.col("delta_ms") * 100 / F.col("interval_ms"), 6))


def busiest(rates: DataFrame, name: str, n: int) -> DataFrame:
    """The n (1 to 50) names of each session with the largest maximum, then mean rate, then name."""
    per = rates.groupBy("session", name).agg(F.max("percent").alias("highest"), F.avg("percent").alias("mean"))
    order = Window.partitionBy("session").orderBy(F.desc("highest"), F.desc("mean"), name)
    return per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(max(n, 1), 50))


def cpu_timeline(rates: DataFrame, n: int = 10, containing: str = "") -> DataFrame:
    """Every measured point of the n (1 to 50) busiest series of each session, with the series' rank and figures.

    `rates` are those of rows of series. A series is named as in its last point; `containing` keeps names that hold it,
    in any case. Order: largest rate, mean rate, name, first row. `available` counts the series that match.
    """
    key = ["session", "first_snapshot", "first_key"]
    per = rates.groupBy(*key).agg(F.max_by("thread_name", "snapshot").alias("name"), F.max("percent").alias("highest"), F.round(F.avg("percent"), 6).alias("mean"), F.count("*").alias("samples"))
    per = generic.cut(per.where(F.lower("name").contains(containing.strip().lower())))
    order = Window.partitionBy("session").orderBy(F.desc("highest"), F.desc("mean"), "name", "first_snapshot", "first_key")
    top = per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(max(n, 1), 50))  # each task keeps its own first n
    available = per.groupBy("session").agg(F.count("*").alias("available"))
    return rates.join(top.join(available, "session"), key)


def interval_summary(rates: DataFrame, name: str, hot_ms: float) -> DataFrame:
    """Per snapshot pair: the name with the largest change (ties: smallest name) and how many are hot."""
    per = rates.groupBy("session", "snapshot").agg(F.max("delta_ms").alias("peak_ms"), F.count_if(F.col("delta_ms") >= hot_ms).alias("hot"))
    top = rates.join(per.select("session", "snapshot", "peak_ms"), ["session", "snapshot"]).where("delta_ms = peak_ms").groupBy("session", "snapshot").agg(F.min(name).alias("peak"))
    return per.join(top, ["session", "snapshot"])


def presence_trend(rows: DataFrame, present, *key: str) -> DataFrame:
    """Per series: snapshots seen, with the sign, changes of it, and its longest and current streak."""
    w = Window.partitionBy(*key).orderBy("snapshot")
    marked = rows.select(*key, "snapshot", present.cast("int").alias("on")).withColumn("changed", F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(0)))
    runs = marked.withColumn("run", F.sum("changed").over(w)).groupBy(*key, "run").agg(F.count("*").alias("n"), F.max("on").alias("on"))
    return runs.groupBy(*key).agg(
        F.sum("n").alias("snapshots"), F.sum(F.col("n") * F.col("on")).alias("present"), F.max("run").alias("transitions"),
        F.max(F.col("n") * F.col("on")).alias("longest"), F.max_by(F.col("n") * F.col("on"), "run").alias("current"),
    )


def continuity(rows: DataFrame, pairs: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows of series with place (from 1) and, by series, total and status.

    identity-unavailable: a thread of it had candidates and none accepted, or isn't linked with the row before;
    insufficient-data: a single row; snapshot-gap: a snapshot lies between two rows (the first break counts); available.
    """
    key = ["session", "first_snapshot", "first_key"]
    whole = Window.partitionBy(*key)
    w = whole.orderBy("snapshot", "source_key")
    tried = pairs.select(*_NODE).distinct().withColumn("_tried", F.lit(True))
    met = rows.join(accepted.select(*_NODE, F.col("before_source_key").alias("_linked")), _NODE, "left").join(tried, _NODE, "left")
    placed = met.withColumn("place", F.row_number().over(w)).withColumn("_before", F.lag("source_key").over(w)).withColumn("_step", F.col("snapshot") - F.lag("snapshot").over(w))
    unlinked = ~F.coalesce(F.col("_linked") == F.col("_before"), F.lit(False))
    broken = F.when(F.col("_step") != 1, "snapshot-gap").when(unlinked, "identity-unavailable")
    first = F.min(F.when((F.col("place") > 1) & broken.isNotNull(), F.struct("place", broken.alias("why")))).over(whole)
    unsure = F.max(F.coalesce(F.col("_tried") & F.col("_linked").isNull(), F.lit(False))).over(whole)
    counted = placed.withColumn("total", F.count("*").over(whole)).withColumn("_first", first).withColumn("_unsure", unsure)
    status = F.when(F.col("_unsure"), "identity-unavailable").when(F.col("total") < 2, "insufficient-data").otherwise(F.coalesce("_first.why", F.lit("available")))
    return counted.withColumn("status", status).drop("_linked", "_tried", "_before", "_step", "_first", "_unsure")


def diagnostic_trends(placed: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row per series and diagnostic met in it: how often, streaks, and growing, shrinking, stable or insufficient-data.

    `placed` comes from continuity(); `diagnostics` has a thread's session, snapshot, source_key and diagnostic (blank
    ones and repeats don't count). Work follows the observations: unbroken runs of places are grouped, and what lies
    between them is counted from their ends, without a row for each place where a diagnostic is absent.
    """
    key = ["session", "first_snapshot", "first_key", "diagnostic"]
    met = diagnostics.where(F.trim("diagnostic") != "").select(*_NODE, "diagnostic").distinct().join(placed.select(*_NODE, "first_snapshot", "first_key", "place", "total", "status"), _NODE)
    island = F.col("place") - F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    runs = met.withColumn("_run", island).groupBy(*key, "total", "status", "_run").agg(F.min("place").alias("start"), F.max("place").alias("stop"), F.count("*").alias("n"), F.min("snapshot").alias("since"), F.max("snapshot").alias("until"))
    opens, closes = F.col("start") > 1, F.col("stop") < F.col("total")
    per = runs.groupBy(*key, "total", "status").agg(
        F.sum("n").alias("present"), F.sum(opens.cast("long") + closes.cast("long")).alias("transitions"), F.max("n").alias("longest"), F.sum(F.when(closes, 0).otherwise(F.col("n"))).alias("current"),
        F.min("since").alias("first_observed"), F.max("until").alias("last_observed"), F.min("start").alias("_start"),
    )
    at_first, at_last = F.col("_start") == 1, F.col("current") > 0
    trend = F.when(F.col("status") != "available", "insufficient-data").when(~at_first & at_last, "growing").when(at_first & ~at_last, "shrinking").otherwise("stable")
    return per.withColumn("trend", trend).drop("_start")


def snapshot_deltas(rows: DataFrame) -> DataFrame:
    """Threads, and those blocked, runnable or waiting, per snapshot and against the one before (null at the first)."""
    s = F.col("java_state")
    per = rows.groupBy("session", "snapshot").agg(F.count("*").alias("threads"), F.count_if(s == "BLOCKED").alias("blocked"), F.count_if(s == "RUNNABLE").alias("runnable"), F.count_if(s.endswith("WAITING")).alias("waiting"))
    w = Window.partitionBy("session").orderBy("snapshot")
    return per.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in ("threads", "blocked", "runnable", "waiting")])


def evenly_spaced(indexes: DataFrame, group: str, index: str, n: int) -> DataFrame:
    """At most n (2 at least) of each group's distinct places 0, 1, ...: the first, the last and even steps between."""
    n = max(n, 2)
    size = indexes.groupBy(group).agg((F.max(index) + 1).alias("size"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * (F.col("size") - 1) / (n - 1)).cast("int"))
    return size.select(group, F.explode(F.when(F.col("size") <= n, F.sequence(F.lit(0), F.col("size").cast("int") - 1)).otherwise(F.array_distinct(steps))).alias(index))
