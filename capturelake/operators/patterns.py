"""What a thread is doing: weighted patterns of frames and the first scenario that its evidence meets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """Points for the first group of methods met (`frames`: names and points), for two groups together, for a state detail."""

    key: str
    priority: int
    frames: tuple[tuple[tuple[str, ...], int], ...]
    states: tuple[str, ...]
    both: int = 0
    detail: str = ""
    detail_alone: int = 0
    detail_too: int = 0
    severity: str = "info"


_WAITING = ("WAITING", "TIMED_WAITING")
#: Runtime patterns, their methods and points.
RUNTIME = (
    Pattern("sleeping", 90, ((("java.lang.Thread.sleep",), 70),), ("TIMED_WAITING",)),
    Pattern("executor-idle", 80, ((("java.util.concurrent.LinkedBlockingQueue.take", "java.util.concurrent.ScheduledThreadPoolExecutor$DelayedWorkQueue.take", "org.apache.tomcat.util.threads.TaskQueue.take", "java.util.concurrent.ForkJoinPool.awaitWork"), 65), (("java.util.concurrent.ThreadPoolExecutor.getTask",), 70)), _WAITING, both=20),
    Pattern("parked", 70, ((("java.util.concurrent.locks.LockSupport.park", "java.util.concurrent.locks.LockSupport.parkNanos", "java.util.concurrent.locks.LockSupport.parkUntil"), 70),), _WAITING, detail="parking", detail_alone=65, detail_too=10),
)
#: Points for a state that fits, and for another one; scores of high and medium confidence.
FITS, CONFLICTS, HIGH, MEDIUM = 15, -25, 85, 60


def _method(frame) -> Column:
    return F.regexp_replace(F.regexp_replace(frame, r"\(.*$", ""), r"^at (\S*/)?", "")


def scored(threads_: DataFrame, patterns: tuple[Pattern, ...] = RUNTIME) -> DataFrame:
    """threads (frames, java_state, state_detail) with `patterns`: matches as (priority, score, key, confidence, severity), the first one first.

    A match needs a frame of the pattern or its state detail; state and companions add or take points, from 0 to 100.
    """
    rows = threads_.withColumn("_m", F.transform("frames", _method))
    found = []
    for p in patterns:
        met = [F.arrays_overlap("_m", F.lit(list(names))) for names, _ in p.frames]
        points = F.coalesce(*[F.when(m, n) for m, (_, n) in zip(met, p.frames, strict=True)])
        told = F.coalesce(F.col("state_detail") == p.detail, F.lit(False)) if p.detail else F.lit(False)
        total = F.coalesce(points, F.when(told, p.detail_alone))
        if p.both:
            total = total + F.when(met[0] & met[1], p.both).otherwise(0)
        total = total + F.when(F.col("java_state").isin(*p.states), FITS).when(F.coalesce("java_state", F.lit("UNKNOWN")) != "UNKNOWN", CONFLICTS).otherwise(0)
        total = total + F.when(points.isNotNull() & told, p.detail_too).otherwise(0)
        score = F.greatest(F.lit(0), F.least(F.lit(100), total))
        confidence = F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
        match = F.struct((-F.lit(p.priority)).alias("before"), (-score).alias("less"), F.lit(p.key).alias("key"), score.alias("score"), confidence.alias("confidence"), F.lit(p.severity).alias("severity"))
        found.append(F.when(total.isNotNull(), match))
    return rows.withColumn("patterns", F.array_sort(F.array_compact(F.array(*found)))).drop("_m")


#: Methods of the waiting paths of java.util.concurrent and of monitors, by what meeting one tells.
_JUC, _AQS = "java.util.concurrent.", "java.util.concurrent.locks.AbstractQueuedSynchronizer"
METHODS = {
    "condition": tuple(f"{_AQS}$ConditionObject.{m}" for m in ("await", "awaitNanos", "awaitUntil", "awaitUninterruptibly")),
    "latch": (f"{_JUC}CountDownLatch.await",),
    "shared": (f"{_AQS}.acquireSharedInterruptibly",),
    "object_wait": ("java.lang.Object.wait", "java.lang.Object.wait0"),
    "read_lock": tuple(f"{_JUC}locks.ReentrantReadWriteLock$ReadLock.{m}" for m in ("lock", "lockInterruptibly")),
    "write_lock": tuple(f"{_JUC}locks.ReentrantReadWriteLock$WriteLock.{m}" for m in ("lock", "lockInterruptibly")),
    "lock": tuple(f"{_JUC}locks.ReentrantLock.{m}" for m in ("lock", "lockInterruptibly", "tryLock")),
    "park": ("jdk.internal.misc.Unsafe.park", "sun.misc.Unsafe.park", *(f"{_JUC}locks.LockSupport.{m}" for m in ("park", "parkNanos", "parkUntil"))),
    "sleep": ("java.lang.Thread.sleep",),
    "selector": (
        *(f"sun.nio.ch.{kind}SelectorImpl.{m}" for kind in ("EPoll", "KQueue", "Poll") for m in ("doSelect", "lockAndDoSelect")), "java.nio.channels.Selector.select",
        *(f"io.netty.channel.{loop}.{m}" for loop in ("nio.NioEventLoop", "epoll.EpollEventLoop", "kqueue.KQueueEventLoop") for m in ("run", "select", "processSelectedKeys")),
        *(f"org.eclipse.jetty.io.ManagedSelector.{m}" for m in ("select", "doSelect", "run")),
    ),
}
#: A class whose frames tell of read-write locks, and names inside the types of held or awaited locks.
RW_CLASS, RW, RL, CONDITION = f"{_JUC}locks.ReentrantReadWriteLock", "ReentrantReadWriteLock", "ReentrantLock", "ConditionObject"
#: Synchronization patterns that mean a thread is acquiring a lock.
ACQUIRING = ("reentrant-lock-contention", "rwlock-reader-wait", "rwlock-writer-lock")
_THREAD = ["capture_id", "snapshot_index", "start_line"]


def evidence(threads_: DataFrame, locks: DataFrame) -> DataFrame:
    """threads with counts of frames by METHODS and of RW_CLASS (`rw_frames`), and what the types of their locks name.

    Frames meet a table of methods, of fixed size, so one join serves all patterns; locks are gathered by thread.
    """
    spark = threads_.sparkSession
    known = spark.createDataFrame([(m, name) for name, methods in METHODS.items() for m in methods], "method string, tells string")
    frames = threads_.select(*_THREAD, F.explode(F.transform("frames", _method)).alias("method"))
    met = frames.join(F.broadcast(known), "method", "left").where(F.col("tells").isNotNull() | F.startswith("method", F.lit(RW_CLASS)))
    counts = met.groupBy(*_THREAD).agg(*[F.count_if(F.col("tells") == name).cast("int").alias(name) for name in METHODS], F.count_if(F.startswith("method", F.lit(RW_CLASS))).cast("int").alias("rw_frames"))
    held, kind = F.col("kind").isin("monitor", "ownable-synchronizer"), F.coalesce("lock_type", F.lit(""))
    names = lambda own, word: F.bool_or(own & F.contains(kind, F.lit(word)))
    of_locks = locks.groupBy(*_THREAD).agg(
        names(held, RW).alias("rw_held"), names(~held, RW).alias("rw_waited"), names(held, RL).alias("rl_held"), names(~held, RL).alias("rl_waited"), names(~held, CONDITION).alias("condition_waited"), F.bool_or(F.col("kind") == "monitor-wait").alias("monitor_waited"),
    )
    both = threads_.join(counts, _THREAD, "left").join(of_locks, _THREAD, "left")
    return both.na.fill(0, [*METHODS, "rw_frames"]).na.fill(False, [c for c in of_locks.columns if c not in _THREAD])


def _match(key: str, priority: int, severity: str, needed: Column, *points: Column | int) -> Column:
    score = F.greatest(F.lit(0), F.least(F.lit(100), sum((F.lit(p) if isinstance(p, int) else p for p in points), F.lit(0))))
    confidence = F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")
    return F.when(needed, F.struct((-F.lit(priority)).alias("before"), (-score).alias("less"), F.lit(key).alias("key"), score.alias("score"), confidence.alias("confidence"), F.lit(severity).alias("severity")))


def synchronization(told: DataFrame) -> DataFrame:
    """threads with `evidence`, with `synchronization`: the matches of nine patterns of waiting on monitors and locks, most specific first.

    A match needs an exact method or a lock type that was printed; a waiting state, companions of the path and lock types
    add points, another state takes some. Names of threads say nothing.
    """
    met = {name: F.col(name) > 0 for name in METHODS}
    if_ = lambda test, n: F.when(test, n).otherwise(0)
    known = F.coalesce("java_state", F.lit("UNKNOWN")) != "UNKNOWN"
    state = F.when(F.col("java_state").isin(*_WAITING), FITS).when(known, CONFLICTS).otherwise(0)
    asleep = (F.col("java_state") == "TIMED_WAITING") & met["sleep"]
    any_rw = F.col("rw_held") | F.col("rw_waited") | (F.col("rw_frames") > 0)
    matches = F.array(
        _match("condition-await", 100, "medium", met["condition"], 70, state, if_(met["park"], 10), if_(F.col("condition_waited"), 5)),
        _match("latch-await", 90, "medium", met["latch"], 70, state, if_(met["shared"], 10)),
        _match("object-wait", 80, "medium", met["object_wait"], 70, state, if_(F.col("object_wait") >= 2, 10), if_(F.col("monitor_waited"), 5)),
        _match("rwlock-reader-wait", 70, "high", met["read_lock"], 75, state, if_(F.col("rw_waited"), 10)),
        _match("rwlock-writer-lock", 69, "medium", met["write_lock"], 75, state, if_(F.col("rw_waited"), 10)),
        _match("rwlock-writer-holder", 68, "medium", F.col("rw_held") & asleep, 100),
        _match("rwlock", 60, "medium", any_rw & ~met["read_lock"] & ~met["write_lock"], F.when(F.col("rw_held") | F.col("rw_waited"), 65).otherwise(60)),
        _match("reentrant-lock-holder", 50, "medium", F.col("rl_held") & asleep, 100),
        _match("reentrant-lock-contention", 49, "high", F.col("rl_waited") | met["lock"], if_(met["lock"], 75), if_(F.col("rl_waited"), F.when(met["lock"], 10).otherwise(55)), state),
    )
    return told.withColumn("synchronization", F.array_sort(F.array_compact(matches)))


def selector(told: DataFrame) -> DataFrame:
    """threads with `evidence`, with `selector`: the match of a selector or event loop, null without such a method."""
    known = F.coalesce("java_state", F.lit("UNKNOWN")) != "UNKNOWN"
    return told.withColumn("selector", _match("selector-event-loop", 80, "info", F.col("selector") > 0, 75, F.when(F.col("java_state") == "RUNNABLE", 10).when(known, -15).otherwise(0)))


def classified(threads_: DataFrame, locks: DataFrame, detail: str = "state_detail") -> DataFrame:
    """threads with runtime `patterns`, `synchronization` (its first match or null), `selector` and `infrastructure`, as `scenario` reads them."""
    rows = threads_ if detail in threads_.columns else threads_.withColumn(detail, F.lit(None).cast("string"))
    told = selector(synchronization(evidence(scored(rows), locks)))
    drop = [*(m for m in METHODS if m != "selector"), "rw_frames", "rw_held", "rw_waited", "rl_held", "rl_waited", "condition_waited", "monitor_waited"]
    return told.withColumn("synchronization", F.try_element_at("synchronization", F.lit(1))).withColumn("infrastructure", F.col("selector").isNotNull()).drop(*drop)


def contention_chains(told: DataFrame, locks: DataFrame) -> DataFrame:
    """Per lock that threads wait for: its type, distinct owners and waiters.

    A park on a lock without an owner in the dump may be a condition, a latch or no lock at all: its thread counts only if
    it is acquiring a lock by its first synchronization pattern (`told`: see `classified`).
    """
    keys = ["capture_id", "snapshot_index", "lock_id"]
    held = locks.where(F.col("kind").isin("monitor", "ownable-synchronizer")).groupBy(*keys).agg(F.count_distinct("start_line").alias("owners"), F.min_by("lock_type", "start_line").alias("held_type"))
    waits = locks.where(F.col("kind").isin("monitor-enter", "synchronizer-park")).join(told.select(*_THREAD, F.coalesce(F.col("synchronization.key").isin(*ACQUIRING), F.lit(False)).alias("acquires")), _THREAD)
    met = waits.join(held, keys, "left").where((F.col("owners") > 0) | (F.col("kind") == "monitor-enter") | F.col("acquires"))
    return met.groupBy(*keys).agg(F.coalesce(F.max("held_type"), F.min_by("lock_type", "start_line")).alias("lock_type"), F.coalesce(F.max("owners"), F.lit(0)).alias("owners"), F.count_distinct("start_line").alias("waiters"))


#: Columns that `scenario` reads; those that are missing count as false.
EVIDENCE = ("deadlocked", "class_stall", "class_wait", "class_initializer", "monitor_waiter", "carrier", "jvm_internal", "infrastructure", "cpu_hot", "allocation_hot", "livelock", "starvation")


def scenario(rows: DataFrame, synchronization: str | None = None) -> DataFrame:
    """rows of `scored` with evidence columns: scenario, its severity and confidence, by the first rule that holds; null where none does.

    `synchronization`: a column with the first match of the synchronization patterns (see `classified`), if they were scored.
    """
    have = {c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False) for c in EVIDENCE}

    def found(key: str) -> Column:
        return F.try_element_at(F.filter("patterns", lambda p: p["key"] == key), F.lit(1))

    pattern = {key: found(key) for key in ("sleeping", "executor-idle", "parked")}
    one = lambda key, severity, confidence: F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity"), confidence.alias("confidence"))
    high, medium, low = F.lit("high"), F.lit("medium"), F.lit("low")
    by_pattern = lambda key: (pattern[key].isNotNull(), one(key, "info", pattern[key]["confidence"]))
    rules = [
        (have["deadlocked"], one("deadlock", "critical", high)), (have["class_stall"], one("class-initialization-stall", "high", medium)), (have["class_wait"], one("class-initialization-wait", "medium", high)),
        (have["class_initializer"], one("class-initializer-with-waiters", "medium", high)), ((F.col("java_state") == "BLOCKED") & have["monitor_waiter"], one("monitor-contention", "high", high)),
    ]
    if synchronization:
        match = F.col(synchronization)
        rules.append((match.isNotNull(), F.struct(match["key"].alias("key"), match["severity"].alias("severity"), match["confidence"].alias("confidence"))))
    rules += [
        by_pattern("sleeping"), (have["carrier"], one("carrier-thread", "info", high)), by_pattern("executor-idle"), (have["jvm_internal"], one("jvm-internal", "info", high)),
        (have["infrastructure"] & have["cpu_hot"], one("hot-selector-event-loop", "medium", medium)), (have["infrastructure"], one("selector-event-loop", "info", medium)), (have["allocation_hot"], one("allocation-hot", "medium", medium)),
        (have["cpu_hot"], one("cpu-hot", "medium", medium)), (have["livelock"], one("possible-livelock", "medium", low)), (have["starvation"], one("possible-starvation", "medium", low)), by_pattern("parked"),
    ]
    first = F.coalesce(*[F.when(test, result) for test, result in rules])
    return rows.withColumn("_s", first).select(*rows.columns, F.col("_s.key").alias("scenario"), F.col("_s.severity").alias("scenario_severity"), F.col("_s.confidence").alias("scenario_confidence"))
