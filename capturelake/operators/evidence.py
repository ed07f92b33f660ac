"""What intervals, counters, locks and names say about threads: comparison intervals, bounded rates, thresholds, findings.

Rows that compare two snapshots are linked rows of operators.series.with_before: a column c and its before_c.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds by which two clocks may differ through floating point alone.
_SLACK = 0.001

#: Fixed thresholds of CPU percent: finding, scenario, scenario high, finding high.
CPU_PROFILES = {
    "balanced": {"application": (2.0, 5.0, 10.0, 20.0), "infrastructure": (5.0, 10.0, 10.0, 15.0)},
    "sensitive": {"application": (1.0, 3.0, 7.0, 12.0), "infrastructure": (3.0, 6.0, 9.0, 12.0)},
    "high-throughput": {"application": (5.0, 10.0, 20.0, 30.0), "infrastructure": (10.0, 20.0, 25.0, 35.0)},
}
#: Fixed thresholds of allocated bytes a second: finding, scenario, high.
ALLOCATION_LIMITS = (1 << 20, 10 << 20, 64 << 20)
#: Shortest interval that a rate is judged on; CPU also on a quarter of it where the rate is high.
SHORTEST_MS = 1000.0


def comparison_interval(both: DataFrame, wall_resolution_ms: float = 1000.0, elapsed_resolution_ms: float = 10.0) -> DataFrame:
    """Linked rows with interval_ms, basis, quality and uncertainty_ms, from epoch_ms and elapsed_s.

    The finer of the two clocks counts where both have moved forward. Clocks that disagree beyond both resolutions, and
    an elapsed counter that falls, are conflicting: no interval. `estimated`: uncertainty above a tenth of the interval.
    """
    wall = F.when(F.col("epoch_ms") > F.col("before_epoch_ms"), (F.col("epoch_ms") - F.col("before_epoch_ms")).cast("double"))
    moved = F.when((F.col("elapsed_s") >= 0) & (F.col("before_elapsed_s") >= 0), (F.col("elapsed_s") - F.col("before_elapsed_s")) * 1000)
    rows = both.withColumn("_wall", wall).withColumn("_moved", moved).withColumn("_elapsed", F.when(F.col("_moved") > 0, F.col("_moved")))
    fell = F.col("_moved") < -elapsed_resolution_ms - _SLACK
    apart = F.abs(F.col("_wall") - F.col("_elapsed")) > wall_resolution_ms + elapsed_resolution_ms + _SLACK
    conflict = F.coalesce(fell, F.lit(False)) | F.coalesce(apart, F.lit(False))
    finer = F.col("_elapsed").isNotNull() & (F.col("_wall").isNull() | F.lit(elapsed_resolution_ms < wall_resolution_ms))
    rows = rows.withColumn("_conflict", conflict).withColumn("_finer", finer)
    rows = rows.withColumn("interval_ms", F.when(~F.col("_conflict"), F.when(F.col("_finer"), F.col("_elapsed")).otherwise(F.col("_wall"))))
    none = F.col("interval_ms").isNull()
    rows = rows.withColumn("uncertainty_ms", F.when(~none, F.when(F.col("_finer"), F.lit(elapsed_resolution_ms)).otherwise(F.lit(wall_resolution_ms))))
    basis = F.when(none, "unavailable").when(F.col("_finer"), "thread-elapsed").otherwise("snapshot-time")
    quality = F.when(F.col("_conflict"), "conflicting").when(none, "unavailable").when(F.col("uncertainty_ms") / F.col("interval_ms") > 0.1, "estimated").otherwise("reliable")
    return rows.withColumn("basis", basis).withColumn("quality", quality).drop("_wall", "_moved", "_elapsed", "_conflict", "_finer")


def bounded_rates(timed: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of comparison_interval with status, delta_low, delta_high and rates a second of a counter known within bounds.

    Status: counter-missing, counter-reset (surely below the counter before), interval-conflict, interval-unavailable,
    computed (exact) or bounded. Bounds of a rounded counter's rate are widened by the clock's uncertainty.
    """
    a, b, a0, b0 = (F.col(c) for c in (low, high, f"before_{low}", f"before_{high}"))
    known, reset = a.isNotNull() & b.isNotNull() & a0.isNotNull() & b0.isNotNull(), b < a0
    exact = (a == b) & (a0 == b0)
    status = (
        F.when(~known, "counter-missing").when(reset, "counter-reset").when(F.col("quality") == "conflicting", "interval-conflict").when(F.col("interval_ms").isNull(), "interval-unavailable")
        .when(exact, "computed").otherwise("bounded")
    )
    rows = timed.withColumn("status", status)
    changed = known & ~reset
    rows = rows.withColumn("delta_low", F.when(changed, F.greatest(F.lit(0), a - b0))).withColumn("delta_high", F.when(changed, F.greatest(F.lit(0), b - a0)))
    slack = F.when(F.col("status") == "bounded", F.col("uncertainty_ms")).otherwise(0.0)
    rated = F.col("status").isin("computed", "bounded") & (F.col("interval_ms") > slack)
    return rows.withColumn("rate_low", F.when(rated, F.col("delta_low") * 1000 / (F.col("interval_ms") + slack))).withColumn("rate_high", F.when(rated, F.col("delta_high") * 1000 / (F.col("interval_ms") - slack)))


def evaluate_cpu(rates: DataFrame, profile: str = "balanced", kind=None) -> DataFrame:
    """Rows (percent, interval_ms, quality) with cpu_status, finding and scenario: null, medium or high.

    `kind`: a column, application (the default) or infrastructure. Estimated intervals are not judged; intervals below
    SHORTEST_MS only where at least a quarter of it and the rate reaches the finding's high level.
    """
    kind = F.lit("application") if kind is None else kind
    limits = CPU_PROFILES[profile]
    level = lambda i: F.when(kind == "infrastructure", limits["infrastructure"][i]).otherwise(limits["application"][i])
    rate, short = F.col("percent"), F.col("interval_ms") < SHORTEST_MS
    strong = (F.col("interval_ms") >= SHORTEST_MS / 4) & (rate >= level(3))
    status = (
        F.when(rate.isNull() | F.col("interval_ms").isNull() | (F.col("interval_ms") <= 0), "rate-unavailable").when(F.col("quality") == "estimated", "interval-imprecise")
        .when(short & ~strong, "sample-too-short").when(short, "measured-high-rate-short-interval").otherwise("measured-rate")
    )
    judged = rates.withColumn("cpu_status", status)
    measured = F.col("cpu_status").startswith("measured")
    grade = lambda hot, high: F.when(measured & (rate >= level(hot)), F.when(rate >= level(high), "high").otherwise("medium"))
    return judged.withColumn("finding", grade(0, 3)).withColumn("scenario", grade(1, 2))


def evaluate_allocation(rates: DataFrame, rate: str = "rate_low") -> DataFrame:
    """Rows (a rate's lower bound, interval_ms, quality) with allocation_status, hot, hot_scenario and high."""
    status = F.when(F.col(rate).isNull() | F.col("interval_ms").isNull(), "rate-unavailable").when(F.col("quality") == "estimated", "interval-imprecise").when(F.col("interval_ms") < SHORTEST_MS, "sample-too-short").otherwise("measured-rate")
    judged = rates.withColumn("allocation_status", status)
    above = lambda i: (F.col("allocation_status") == "measured-rate") & F.coalesce(F.col(rate) >= ALLOCATION_LIMITS[i], F.lit(False))
    return judged.withColumn("hot", above(0)).withColumn("hot_scenario", above(1)).withColumn("high", above(2))


#: Fixed names of the JVM's own threads: whole names, then beginnings.
JVM_THREADS = ("DestroyJavaVM", "VM Thread", "Reference Handler", "Finalizer", "Signal Dispatcher", "Attach Listener", "Service Thread", "Monitor Deflation Thread", "Notification Thread", "Common-Cleaner")
JVM_BEGINNINGS = ("GC Thread#", "G1 ", "C1 CompilerThread", "C2 CompilerThread")


def findings(threads_: DataFrame, many: int = 3) -> DataFrame:
    """thread rows (finding, hot, high, waiters, tier, infrastructure) exploded to one row per finding: key and severity.

    Threads of the JVM itself have none. `waiters` counts those that wait for the thread.
    """
    own = F.col("thread_name").isin(*JVM_THREADS)
    for start in JVM_BEGINNINGS:
        own = own | F.col("thread_name").startswith(start)
    one = lambda test, key, severity: F.when(test, F.struct(F.lit(key).alias("key"), severity.alias("severity")))
    medium, hot = F.lit("medium"), F.col("finding").isNotNull()
    found = F.array_compact(
        F.array(
            one(hot & ~F.col("infrastructure"), "cpu-hot", F.col("finding")),
            one(F.col("hot"), "allocation-hot", F.when(F.col("high"), "high").otherwise(medium)),
            one(F.col("waiters") >= many, "many-waiters", medium),
            one(F.col("tier") == "likely-blocker", "likely-lock-bottleneck", medium),
            one(hot & F.col("infrastructure"), "infra-hot", F.col("finding")),
        )
    )
    return threads_.where(~F.coalesce(own, F.lit(False))).withColumn("_f", F.explode(found)).select("*", "_f.key", "_f.severity").drop("_f")


def lock_transitions(both: DataFrame) -> DataFrame:
    """Linked rows (held_locks, contended_locks: arrays) with locks held at both ends, appeared, gone, and contended at both.

    Endpoints only: nothing is said about the time between. Nulls count as no locks.
    """
    at = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    now, before = at("held_locks"), at("before_held_locks")
    return both.select(
        "*", F.array_intersect(now, before).alias("held_at_both"), F.array_except(now, before).alias("appeared"), F.array_except(before, now).alias("gone"),
        F.array_intersect(at("contended_locks"), at("before_contended_locks")).alias("contended_at_both"),
    )


def process_segments(rows: DataFrame, key: str, order: str, process: str) -> DataFrame:
    """rows with segment: a process id that differs from the last known one begins a new segment; a null does not."""
    w = Window.partitionBy(key).orderBy(order)
    last = F.last(process, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.coalesce((F.col(process) != last).cast("int"), F.lit(0))
    return rows.withColumn("_changed", changed).withColumn("segment", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def resolve_references(references: DataFrame, threads_: DataFrame) -> DataFrame:
    """References (capture_id, snapshot_index, ref_id, ref_key, ref_name, ref_locks) with status, reason and resolved_key.

    In turn: an equal source_key, a name only one thread has, the only thread of the name that waits for one of
    ref_locks; else ambiguous or missing. `threads_` have source_key, thread_name and waiting_locks.
    """
    keys = ["capture_id", "snapshot_index"]
    exact = threads_.groupBy(*keys, F.col("source_key").alias("ref_key")).agg(F.count("*").alias("_same"))
    named = threads_.select(*keys, F.col("thread_name").alias("ref_name"), "source_key", "waiting_locks")
    fits = F.coalesce(F.arrays_overlap("ref_locks", "waiting_locks"), F.lit(False))
    met = references.join(named, [*keys, "ref_name"]).groupBy(*keys, "ref_id").agg(
        F.count("*").alias("_named"), F.min("source_key").alias("_first"), F.count_if(fits).alias("_fit"), F.min(F.when(fits, F.col("source_key"))).alias("_fitting")
    )
    rows = references.join(exact, [*keys, "ref_key"], "left").join(met, [*keys, "ref_id"], "left")
    reason = (
        F.when(F.col("_same") == 1, "exact-source-key").when(F.col("ref_name").isNull(), "name-not-supplied").when(F.col("_named").isNull(), "name-not-found").when(F.col("_named") == 1, "unique-name")
        .when(F.col("_fit") == 1, "name-and-waiting-lock").otherwise("duplicate-name-without-unique-evidence")
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason").isin("name-not-supplied", "name-not-found"), "missing").when(F.col("reason").startswith("duplicate"), "ambiguous").otherwise("resolved")
    found = F.when(F.col("reason") == "exact-source-key", F.col("ref_key")).when(F.col("reason") == "unique-name", F.col("_first")).when(F.col("reason") == "name-and-waiting-lock", F.col("_fitting"))
    return rows.withColumn("status", status).withColumn("resolved_key", found).drop("_same", "_named", "_first", "_fit", "_fitting")


def annotate_deadlocks(entries: DataFrame, threads_: DataFrame) -> DataFrame:
    """Deadlock entries (threads.deadlock_entries) with the source keys of both ends, and whether both are resolved."""
    keys, at = ["capture_id", "snapshot_index"], ["cycle_id", "entry_no"]
    none = F.lit(None).cast("string")
    lock = F.array("waiting_lock_id")
    rows = entries.withColumn("ref_id", F.struct(*at))
    ends = {"waiter": ("thread_name", lock), "holder": ("held_by", F.array().cast("array<string>"))}
    for end, (name, locks) in ends.items():
        found = resolve_references(rows.select(*keys, "ref_id", none.alias("ref_key"), F.col(name).alias("ref_name"), locks.alias("ref_locks")), threads_)
        rows = rows.join(found.select(*keys, "ref_id", F.col("resolved_key").alias(f"{end}_key"), F.col("status").alias(f"{end}_status")), [*keys, "ref_id"], "left")
    return rows.withColumn("mapped", F.col("waiter_key").isNotNull() & F.col("holder_key").isNotNull()).drop("ref_id")


#: Fixed beginnings of frames that say nothing about what a thread does, and of the JDK's own packages.
GENERIC_FRAMES = (
    "java.lang.Thread.run", "java.lang.VirtualThread.run", "java.lang.VirtualThread$", "jdk.internal.reflect.", "sun.reflect.", "java.base@", "java.lang.Object.wait", "jdk.internal.misc.Unsafe.park",
    "sun.misc.Unsafe.park",
)
JDK_FRAMES = ("java.", "javax.", "jdk.", "sun.", "com.sun.")


def fingerprints(threads_: DataFrame) -> DataFrame:
    """Rows (frames) with meaningful_frames, app_frames and strict (8), relaxed (5) and app (4) fingerprints."""
    from capturelake.operators.threads import normalize_frames

    bare = F.transform(normalize_frames("frames"), lambda f: F.regexp_replace(f, r"^at ", ""))

    def begins(frame, names):
        out = frame == ""
        for n in names:
            out = out | frame.startswith(n)
        return out

    rows = threads_.withColumn("meaningful_frames", F.filter(bare, lambda f: ~begins(f, GENERIC_FRAMES)))
    rows = rows.withColumn("app_frames", F.filter("meaningful_frames", lambda f: ~begins(f, JDK_FRAMES)))
    joined = lambda c, n: F.array_join(F.slice(c, 1, n), " | ")
    return rows.withColumn("strict_fingerprint", joined("meaningful_frames", 8)).withColumn("relaxed_fingerprint", joined("meaningful_frames", 5)).withColumn("app_fingerprint", joined("app_frames", 4))


def lcs_length(a, b) -> F.Column:
    """Length of the longest common subsequence of two arrays of strings, row by row of the usual table."""
    first = F.array_repeat(F.lit(0), F.size(b) + 1)

    def next_row(row, x):
        cells = F.arrays_zip(b.alias("y"), F.slice(row, F.lit(1), F.size(b)).alias("corner"), F.slice(row, F.lit(2), F.size(b)).alias("above"))
        return F.aggregate(cells, F.array(F.lit(0)), lambda acc, c: F.array_append(acc, F.when(c["y"] == x, c["corner"] + 1).otherwise(F.greatest(c["above"], F.element_at(acc, -1)))))

    return F.element_at(F.aggregate(a, first, next_row), -1)


def stack_diff(both: DataFrame, before: str, now: str) -> DataFrame:
    """Rows with counts of lines that are the same, removed and added between two normalized stacks; null is empty."""
    empty = F.array().cast("array<string>")
    rows = both.withColumn("_a", F.coalesce(F.col(before), empty)).withColumn("_b", F.coalesce(F.col(now), empty))
    rows = rows.withColumn("same", lcs_length(F.col("_a"), F.col("_b")))
    return rows.withColumn("removed", F.size("_a") - F.col("same")).withColumn("added", F.size("_b") - F.col("same")).drop("_a", "_b")


def count_timeline(rows: DataFrame, places: DataFrame, session: str, group: str, index: str) -> DataFrame:
    """(session, group, index, n): counts of every group at every place of its session; null where `complete` is false."""
    grid = rows.select(session, group).distinct().join(places.select(session, index, "complete"), session)
    counted = rows.groupBy(session, group, index).agg(F.count("*").alias("n"))
    return grid.join(counted, [session, group, index], "left").select(session, group, index, F.when(F.col("complete"), F.coalesce("n", F.lit(0))).alias("n"))


def count_trend(timeline: DataFrame, index: str, *key: str) -> DataFrame:
    """Per key the trend of its counts at consecutive places: Unavailable, None, Growing, Fading, Persistent, Bursty, Intermittent, Stable."""
    on = F.when(F.col("n") > 0, F.col(index))
    per = timeline.groupBy(*key).agg(
        F.count_if(F.col("n").isNull()).alias("unknown"), F.count("*").alias("places"), F.count(on).alias("seen"), F.min(on).alias("from"), F.max(on).alias("to"),
        F.min_by("n", on).alias("first"), F.max_by("n", on).alias("last"),
    )
    moved = lambda level: F.when(F.col("last") > F.col("first"), "Growing").when(F.col("last") < F.col("first"), "Fading").otherwise(level)
    label = (
        F.when(F.col("unknown") > 0, "Unavailable").when(F.col("seen") == 0, "None").when(F.col("seen") == F.col("places"), moved("Persistent")).when(F.col("seen") <= 2, "Bursty")
        .when(F.col("to") - F.col("from") + 1 > F.col("seen"), "Intermittent").otherwise(moved("Stable"))
    )
    return per.select(*key, "seen", label.alias("trend"))


def interval_matrix(rates: DataFrame, group: str, series: str, interval: str, value: str, intervals: list, n: int) -> DataFrame:
    """One row per series, one column per stated interval (null where it has no value), the n series of each group with the highest value."""
    wide = rates.groupBy(group, series).pivot(interval, intervals).agg(F.max(value))
    top = wide.withColumn("highest", F.greatest(*[F.col(f"`{i}`") for i in intervals]) if len(intervals) > 1 else F.col(f"`{intervals[0]}`")).where("highest IS NOT NULL")
    order = Window.partitionBy(group).orderBy(F.desc("highest"), series)
    return top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def interval_rows(rates: DataFrame, group: str, series: str, interval: str, value: str, n: int) -> DataFrame:
    """One row per series and interval of its group, whatever their number (null where it has no value), of the n series of each group with the highest value."""
    cells = rates.groupBy(group, series, interval).agg(F.max(value).alias(value))
    best = cells.groupBy(group, series).agg(F.max(value).alias("highest")).where("highest IS NOT NULL")
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("highest"), series))).where(F.col("rank") <= n)
    return top.join(cells.select(group, interval).distinct(), group).join(cells, [group, series, interval], "left").select(group, series, interval, value, "highest", "rank")


def graph_metrics(threads_: DataFrame, locks: DataFrame) -> DataFrame:
    """Per snapshot: threads, locks by kind, hold and wait relations, unresolved and ambiguous waits, fan-in, isolated threads."""
    from capturelake.operators import threads as T

    keys = ["capture_id", "snapshot_index"]
    index, rel = T.lock_index(locks), T.relations(locks)
    of_locks = index.groupBy(*keys).agg(
        F.count("*").alias("locks"), F.count_if(F.col("category") == "monitor").alias("monitors"), F.count_if(F.col("category") == "synchronizer").alias("synchronizers"),
        F.count_if(F.col("contended") > 0).alias("contended_locks"), F.max("contended").alias("largest_fan_in"),
    )
    holds = locks.where(F.col("kind").isin(*T.HOLDS)).select(*keys, "start_line", "lock_id").distinct().groupBy(*keys).agg(F.count("*").alias("hold_relations"))
    waits = rel.groupBy(*keys).agg(F.count("*").alias("wait_relations"), F.count_if(F.col("resolution") == "owner-not-observed").alias("unresolved_waits"), F.count_if(F.col("resolution") == "multiple-observed-owners").alias("ambiguous_waits"))
    edged = locks.select(*keys, "start_line").distinct().withColumn("_edge", F.lit(1))
    people = threads_.join(edged, [*keys, "start_line"], "left").groupBy(*keys).agg(F.count("*").alias("threads"), F.count_if(F.col("_edge").isNull()).alias("isolated_threads"))
    return people.join(of_locks, keys, "left").join(holds, keys, "left").join(waits, keys, "left").na.fill(0)


def best_package(packages: DataFrame, group: str, version: str, key: str) -> DataFrame:
    """Of each group the row with the highest version, its numbers compared as numbers, then the highest key."""
    parts = F.transform(F.regexp_extract_all(F.col(version), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    order = Window.partitionBy(group).orderBy(F.desc(parts), F.desc(key))
    return packages.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def evidence_matrix(cases: DataFrame, version: str, analyzer: str, vendor: str, analyzers: list[str]) -> DataFrame:
    """One row per version, one column per stated analyzer: its distinct vendors in order, or null."""
    listed = lambda name: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col(analyzer) == name, F.col(vendor)))), ", "), F.lit(""))
    return cases.groupBy(version).agg(*[listed(name).alias(name) for name in analyzers])
