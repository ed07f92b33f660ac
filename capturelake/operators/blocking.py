"""Who waits for whom: edges of a snapshot, their dependents, and patterns over the snapshots of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators import generic, threads

_KEYS = ["capture_id", "snapshot_index"]


def resource_edges(locks: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Distinct edges of threads and resources: hold, wait, park, await, initialize, class-init-wait."""
    kind = F.create_map(*[F.lit(x) for x in ("monitor", "hold", "ownable-synchronizer", "hold", "monitor-enter", "wait", "synchronizer-park", "park", "monitor-wait", "await")])[F.col("kind")]
    edges = locks.select(*_KEYS, "start_line", F.concat(F.lit("lock:"), F.lower("lock_id")).alias("resource"), kind.alias("edge"))
    if classes is not None:
        of_class = F.when(F.col("kind") == "class-initializer", "initialize").otherwise("class-init-wait")
        edges = edges.unionByName(classes.select(*_KEYS, "start_line", F.concat(F.lit("class:"), F.col("class_name")).alias("resource"), of_class.alias("edge")))
    return edges.distinct()


def dependency_edges(locks: DataFrame) -> DataFrame:
    """Waiter and owner threads (lines) of a snapshot, merged by pair: locks, observations, and whether another owner was seen too."""
    waits = locks.where(F.col("kind").isin(*threads.CONTENDED)).select(*_KEYS, "lock_id", F.col("start_line").alias("waiter"))
    holds = locks.where(F.col("kind").isin(*threads.HOLDS)).select(*_KEYS, "lock_id", F.col("start_line").alias("owner")).distinct()
    owners = holds.groupBy(*_KEYS, "lock_id").agg(F.count("*").alias("owners"))
    met = waits.join(holds, [*_KEYS, "lock_id"]).join(owners, [*_KEYS, "lock_id"])
    return met.groupBy(*_KEYS, "waiter", "owner").agg(F.array_sort(F.collect_set("lock_id")).alias("locks"), F.count("*").alias("observations"), F.bool_or(F.col("owners") > 1).alias("ambiguous"))


def class_edges(classes: DataFrame) -> DataFrame:
    """Edges from threads that wait for a class to the one that initializes it in their snapshot; ambiguous where several do."""
    keys = [*_KEYS, "class_name"]
    waits = classes.where("kind = 'class-initialization-wait'").select(*keys, F.col("start_line").alias("waiter"))
    owns = classes.where("kind = 'class-initializer'").select(*keys, F.col("start_line").alias("owner")).distinct()
    owners = owns.groupBy(*keys).agg(F.count("*").alias("owners"))
    met = waits.join(owns, keys).join(owners, keys)
    return met.groupBy(*_KEYS, "waiter", "owner").agg(F.array_sort(F.collect_set(F.concat(F.lit("class:"), "class_name"))).alias("locks"), F.count("*").alias("observations"), F.bool_or(F.col("owners") > 1).alias("ambiguous"))


def _named(end: str):
    # a nullable name: checkpoints of unions of columns that cannot be null fail in Spark 4.1
    return F.nullif(F.concat_ws("\t", "capture_id", F.col("snapshot_index").cast("string"), F.col(end).cast("string")), F.lit(""))


def cycle_metrics(edges: DataFrame) -> DataFrame:
    """Per snapshot with edges (waiter, owner): threads on edges, distinct edges, cycles, threads in them, and the longest chain of waits.

    A cycle is a strongly connected part of two threads or more, or a thread that waits for itself; the longest chain is
    counted with cycles drawn together. Threads are named by snapshot, so all snapshots of all captures go in one run.
    """
    named = generic.cut(edges.select(_named("waiter").alias("source"), _named("owner").alias("target")).distinct())
    parts = generic.cut(generic.strong_components(named))
    turns = named.where("source = target").select(F.col("source").alias("node"), F.lit(True).alias("turns"))
    per_part = parts.join(turns, "node", "left").groupBy("component").agg(F.count("*").alias("members"), F.coalesce(F.bool_or("turns"), F.lit(False)).alias("turns"))
    snapshot = lambda c: [F.split(c, "\t")[0].alias("capture_id"), F.split(c, "\t")[1].cast("int").alias("snapshot_index")]
    cyclic = (F.col("members") > 1) | F.col("turns")
    of_parts = per_part.groupBy(*snapshot("component")).agg(F.sum("members").alias("threads"), F.count_if(cyclic).alias("cycles"), F.coalesce(F.sum(F.when(cyclic, F.col("members"))), F.lit(0)).alias("cyclic_threads"))
    of_edges = named.groupBy(*snapshot("source")).agg(F.count("*").alias("edges"))
    longest = generic.depths(named).groupBy(*snapshot("node")).agg(F.max("depth").alias("depth"))
    return of_parts.join(of_edges, _KEYS).join(longest, _KEYS)


def dependents(edges: DataFrame) -> DataFrame:
    """Per blocker of a snapshot: threads that wait for it directly, indirectly and in all through edges with one owner, and those only seen through ambiguous ones."""
    named = generic.cut(edges.select(_named("waiter").alias("source"), _named("owner").alias("target"), "ambiguous"))
    sure = named.where("NOT ambiguous").select("source", "target")
    of = lambda part, name: generic.ancestor_counts(part.select("source", "target")).select(F.col("node").alias("target"), F.col("n").alias(name))
    every, definite = of(named, "all_of"), of(sure, "dependents")
    direct = sure.where("source <> target").groupBy("target").agg(F.count_distinct("source").alias("direct"))
    blockers = named.select("target").distinct().join(every, "target", "left").join(definite, "target", "left").join(direct, "target", "left").na.fill(0)
    part = F.split("target", "\t")
    return blockers.select(part[0].alias("capture_id"), part[1].cast("int").alias("snapshot_index"), part[2].cast("int").alias("start_line"), "direct", (F.col("dependents") - F.col("direct")).alias("indirect"), "dependents", (F.col("all_of") - F.col("dependents")).alias("uncertain"))


def patterns(observed: DataFrame, accepted: DataFrame) -> DataFrame:
    """Blockers over a session: rows (session, snapshot, source_key, series, dependents) of one blocker in one snapshot each.

    Per series: snapshots seen, peak dependents, and recurrences: adjacent snapshots linked by identity, both with a
    definite dependent. Ranked by peak, recurrences, then series.
    """
    now = observed.join(accepted, ["session", "snapshot", "source_key"], "left")
    before = observed.select("session", (F.col("snapshot") + 1).alias("snapshot"), F.col("source_key").alias("before_source_key"), F.col("dependents").alias("before_dependents"))
    both = now.join(before, ["session", "snapshot", "before_source_key"], "left")
    again = (F.col("dependents") > 0) & (F.col("before_dependents") > 0)
    per = both.groupBy("session", "series").agg(F.count("*").alias("snapshots"), F.max("dependents").alias("peak"), F.count_if(again).alias("recurrences"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("peak"), F.desc("recurrences"), "series")))


def relation_changes(relations: DataFrame, linked: DataFrame) -> DataFrame:
    """Relations (session, snapshot, waiter, owner: series) with their change against the snapshot before.

    `observed again` or `newly observed` where both ends are linked to that snapshot (`linked`: session, snapshot,
    series), else `uncertain`; relations of the snapshot before that are gone are `not observed in this snapshot`.
    """
    keys = ["session", "snapshot", "waiter", "owner"]
    now = relations.select(*keys).distinct()
    before = now.withColumn("snapshot", F.col("snapshot") + 1)
    end = lambda name: linked.select("session", "snapshot", F.col("series").alias(name), F.lit(True).alias(f"{name}_linked"))
    rows = now.withColumn("is_now", F.lit(True)).join(before.withColumn("was", F.lit(True)), keys, "full").join(end("waiter"), ["session", "snapshot", "waiter"], "left").join(end("owner"), ["session", "snapshot", "owner"], "left")
    known = relations.select("session", "snapshot").distinct().union(linked.select("session", "snapshot").distinct()).distinct()
    sure = F.coalesce(F.col("waiter_linked"), F.lit(False)) & F.coalesce(F.col("owner_linked"), F.lit(False))
    change = F.when(F.col("is_now").isNull(), "not observed in this snapshot").when(~sure, "uncertain").when(F.col("was"), "observed again").otherwise("newly observed")
    return rows.join(known, ["session", "snapshot"], "left_semi").select(*keys, change.alias("change"))


def pattern_status(observed: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every pattern at every snapshot of its session (session, snapshot, comparable): observed, not observed (the snapshot before had it and both can be compared) or uncertain."""
    seen = observed.select("session", "snapshot", "series").distinct()
    grid = seen.select("session", "series").distinct().join(snapshots, "session")
    before = seen.select("session", (F.col("snapshot") + 1).alias("snapshot"), "series", F.lit(True).alias("was"))
    rows = grid.join(seen.withColumn("is_now", F.lit(True)), ["session", "snapshot", "series"], "left").join(before, ["session", "snapshot", "series"], "left")
    status = F.when(F.col("is_now"), "observed").when(F.col("was") & F.col("comparable"), "not observed").otherwise("uncertain")
    return rows.select("session", "series", "snapshot", status.alias("status"))


def earlier_evidence(points: DataFrame, observations: DataFrame) -> DataFrame:
    """For the last point of each series (session, series, snapshot), its earlier lock observations (with lock_id, relation, waiters): first and last snapshot, count and most waiters."""
    last = points.groupBy("session", "series").agg(F.max("snapshot").alias("last_point"))
    met = observations.join(last, ["session", "series"]).where("snapshot < last_point")
    return met.groupBy("session", "series", "last_point", "relation", "lock_id").agg(F.min("snapshot").alias("first_seen"), F.max("snapshot").alias("last_seen"), F.count("*").alias("times"), F.max("waiters").alias("most_waiters"))


def problem_summary(found: DataFrame) -> DataFrame:
    """Findings (capture_id, snapshot_index, category, severity, confidence, thread_name, resource) by snapshot and category: threads, resources, highest severity, lowest confidence."""
    rank = lambda c, words: F.array_position(F.lit(list(words)), F.col(c))
    severities, confidences = ("critical", "high", "medium", "low", "info"), ("high", "medium", "low")
    per = found.withColumn("_s", rank("severity", severities)).withColumn("_c", rank("confidence", confidences)).groupBy(*_KEYS, "category").agg(
        F.count_distinct("thread_name").alias("threads"), F.count_distinct("resource").alias("resources"), F.min("_s").alias("_s"), F.max("_c").alias("_c")
    )
    return per.select(*_KEYS, "category", "threads", "resources", F.element_at(F.lit(list(severities)), F.col("_s").cast("int")).alias("severity"), F.element_at(F.lit(list(confidences)), F.col("_c").cast("int")).alias("confidence"))


def rolled_up(findings: DataFrame) -> DataFrame:
    """Findings (capture_id, finding_id, kind, locks, people: sorted arrays) with the contention finding that a bottleneck falls under: equal locks, and its waiters all among the bottleneck's people."""
    above = findings.where("kind = 'observed-lock-contention'").select("capture_id", F.col("finding_id").alias("parent"), F.col("locks").alias("parent_locks"), F.col("people").alias("waiters"))
    low = findings.where("kind = 'likely-lock-bottleneck'")
    met = low.join(above, (low["capture_id"] == above["capture_id"]) & (low["locks"] == above["parent_locks"])).where(F.size(F.array_except("waiters", "people")) == 0)
    under = met.groupBy(low["capture_id"], "finding_id").agg(F.min("parent").alias("parent"))
    return findings.join(under, ["capture_id", "finding_id"], "left")


#: Locks and waiters for each lock that a density shows; None shows all.
DENSITIES = {"compact": (5, 6), "balanced": (10, 12), "complete": (None, None)}
#: Weights of a lock's waiters, owners, having an owner and being a monitor; of a waiter's state, of its also
#: owning, of a finding (and the most of them), of its severity score.
LOCK_WEIGHTS, STATE_WEIGHTS = (10_000, 1_500, 4_000, 250), (("BLOCKED", 1_000_000), ("WAITING", 350_000), ("TIMED_WAITING", 250_000))
OWNS, FINDING, FINDINGS, SEVERITY = 50_000, 250, 10_000, 10


def ranked_contention(people: DataFrame, locks: DataFrame, deadlocked: DataFrame, monitors: bool = True, synchronizers: bool = True, unresolved: bool = True) -> DataFrame:
    """One row per wait on a lock of a snapshot, with the lock's and the waiter's rank: what `visible_contention` cuts.

    `people`: threads with thread_name, java_state and, where known, severity_score, finding_count and deadlocked;
    `deadlocked`: locks (capture_id, snapshot_index, lock_id) of confirmed deadlocks. Deadlocked locks have lock_rank 0, as
    they stand outside every limit; the others are ranked by weight, then id. Kinds of locks can be left out, and with
    `unresolved` false also locks without an owner, but deadlocked ones.
    """
    have = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)) if c in people.columns else F.lit(0).cast(kind)
    key = [*_KEYS, "lock_id"]
    waits = locks.where(F.col("kind").isin(*threads.CONTENDED)).select(*key, "start_line").distinct()
    monitor = F.col("kind").isin("monitor", "monitor-enter", "monitor-wait")
    per = locks.groupBy(*key).agg(
        F.count_distinct(F.when(F.col("kind").isin(*threads.CONTENDED), F.col("start_line"))).alias("waiters"), F.count_distinct(F.when(F.col("kind").isin(*threads.HOLDS), F.col("start_line"))).alias("owners"),
        F.when(F.bool_and(monitor), "monitor").when(F.bool_or(monitor), "mixed").otherwise("synchronizer").alias("resource"),
    )
    per = per.join(deadlocked.select(*key).distinct().withColumn("deadlock", F.lit(True)), key, "left").withColumn("deadlock", F.coalesce("deadlock", F.lit(False))).where("waiters > 0")
    shown = {"monitor": monitors, "synchronizer": synchronizers, "mixed": monitors or synchronizers}
    per = per.where(F.col("resource").isin(*[k for k, v in shown.items() if v]) & ((F.col("owners") > 0) | F.col("deadlock") | F.lit(unresolved)))
    waiter, owner, owned, own_kind = LOCK_WEIGHTS
    weight = F.col("waiters") * waiter + F.col("owners") * owner + F.when(F.col("owners") > 0, owned).otherwise(0) + F.when(F.col("resource") == "monitor", own_kind).otherwise(0)
    by_weight = Window.partitionBy(*_KEYS, "deadlock").orderBy(F.desc("weight"), "lock_id")
    per = per.withColumn("weight", weight).withColumn("lock_rank", F.when(F.col("deadlock"), 0).otherwise(F.row_number().over(by_weight)))
    holders = locks.where(F.col("kind").isin(*threads.HOLDS)).select(*_KEYS, "start_line", F.lit(True).alias("owns")).distinct()
    of = people.select(*_KEYS, "start_line", "thread_name", "java_state", have("severity_score", "long").alias("severity_score"), have("finding_count", "long").alias("finding_count"), have("deadlocked", "boolean").alias("in_deadlock"))
    state = F.coalesce(*[F.when(F.col("java_state") == name, n) for name, n in STATE_WEIGHTS], F.lit(0))
    urgency = F.col("severity_score") * SEVERITY + state + F.when(F.col("owns"), OWNS).otherwise(0) + F.least(F.lit(FINDINGS), F.col("finding_count") * FINDING)
    rows = waits.join(per, key).join(of, [*_KEYS, "start_line"]).join(holders, [*_KEYS, "start_line"], "left").withColumn("urgency", urgency)
    by_urgency = Window.partitionBy(*key).orderBy(F.desc("in_deadlock"), F.desc("urgency"), "thread_name", "start_line")
    return rows.withColumn("waiter_rank", F.row_number().over(by_urgency))


def visible_contention(ranked: DataFrame, density: str | tuple[int | None, int | None] = "compact") -> DataFrame:
    """The waits that a density shows: of its locks its waiters, with every deadlocked lock and every deadlocked waiter of one."""
    most_locks, most_waiters = DENSITIES[density] if isinstance(density, str) else density
    within = lambda c, n: F.lit(True) if n is None else F.col(c) <= n
    return ranked.where(within("lock_rank", most_locks) & (within("waiter_rank", most_waiters) | (F.col("deadlock") & F.col("in_deadlock"))))


def hidden_contention(ranked: DataFrame, density: str | tuple[int | None, int | None] = "compact") -> DataFrame:
    """Per snapshot with contention: locks and waits in all, and how many of each a density hides."""
    shown = visible_contention(ranked, density).groupBy(*_KEYS).agg(F.count_distinct("lock_id").alias("_locks"), F.count("*").alias("_waits"))
    every = ranked.groupBy(*_KEYS).agg(F.count_distinct("lock_id").alias("locks"), F.count("*").alias("waits"))
    return every.join(shown, _KEYS, "left").select(*_KEYS, "locks", "waits", (F.col("locks") - F.coalesce("_locks", F.lit(0))).alias("hidden_locks"), (F.col("waits") - F.coalesce("_waits", F.lit(0))).alias("hidden_waits"))
