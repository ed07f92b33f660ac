"""Thread dumps: snapshots, threads, locks, and what they say across snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators import carry, generic

_BOUNDARY = r"^Full thread dump "
_STAMP = r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d"


#: What a line may be at the head of a snapshot, by letter: the boundary, a clock, a clock in ISO form, a process id, a number alone, a version.
_SHAPES = (
    ("B", _BOUNDARY),
    ("S", r"^\s*\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\s*$"),
    ("I", r"^\s*\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\s*$"),
    ("P", r"^\s*[1-9]\d*:\s*$"),
    ("D", r"^\s*\d+\s*$"),
    ("V", r"^\d+[.\-+]"),
)
#: How each of them begins: other lines are not held against the shapes.
_SHAPED = r"^(Full thread dump |\s*\d)"


def snapshots(lines: DataFrame, width: int | None = None) -> DataFrame:
    """lines with snapshot_index; text before the first snapshot belongs to it, and a capture without a boundary is one.

    A snapshot begins at its boundary line, or above it: at a clock line, at a process id above that clock, at a
    collector's ISO clock above both. A dump to a file begins with a number, a clock and a version, one a line.
    """
    shape = F.coalesce(*[F.when(F.col("text").rlike(p), letter) for letter, p in _SHAPES])
    shaped = lines.where(F.col("text").rlike(_SHAPED)).select("capture_id", "line_no", shape.alias("shape")).where("shape IS NOT NULL")
    at = F.struct("line_no", "shape")  # lines without a shape are left out, so a neighbour's number tells how far it is
    near = carry.beside(shaped, ["capture_id"], "line_no", 3, width, b1=(-1, at), a1=(1, at), a2=(2, at), a3=(3, at))
    met = lambda step, *names: F.coalesce(*[F.when(F.col(f"{n}.line_no") == F.col("line_no") + step, F.col(f"{n}.shape")) for n in names], F.lit("-"))
    own, up, down, down2, down3 = F.col("shape"), met(-1, "b1"), met(1, "a1"), met(2, "a1", "a2"), met(3, "a1", "a2", "a3")
    clock = lambda c: c.isin("S", "I")
    starts = (
        ((own == "B") & ~clock(up))
        | (clock(own) & (down == "B") & (up != "P"))
        | ((own == "P") & clock(down) & (down2 == "B") & (up != "I"))
        | ((own == "I") & (down == "P") & clock(down2) & (down3 == "B"))
        | ((own == "D") & clock(down) & down2.isin("V", "D", "S", "I"))
    )
    begun = generic.cut(near.where(starts).select("capture_id", "line_no", F.lit(1).alias("starts")))  # a line or two of each snapshot
    flagged = lines.join(begun, ["capture_id", "line_no"], "left").select(*lines.columns, "starts")
    counted = carry.carried(flagged, ["capture_id"], carry.stretch("line_no", width), ["line_no"], 0 if width else carry.WHOLE, snapshot_index=carry.total(F.col("starts")))
    return counted.select(*lines.columns, F.greatest(F.lit(0), F.col("snapshot_index") - 1).alias("snapshot_index"))


def snapshot_times(marked: DataFrame) -> DataFrame:
    """Per snapshot: raw timestamp, epoch_ms, and its order against the one before (first, ordered, duplicate, reversed, unavailable)."""
    raw = marked.groupBy("capture_id", "snapshot_index").agg(F.min_by("text", F.when(F.col("text").rlike(_STAMP), F.col("line_no"))).alias("t"))
    raw = raw.withColumn("timestamp_raw", F.nullif(F.regexp_extract("t", r"^(\S+ \S+)", 1), F.lit(""))).withColumn("epoch_ms", F.unix_millis(F.try_to_timestamp("timestamp_raw")))
    raw = carry.beside(raw, ["capture_id"], "snapshot_index", 1, before=(-1, F.col("epoch_ms")))
    before = F.col("before")
    status = F.when(F.col("snapshot_index") == 0, "first").when(F.col("epoch_ms").isNull() | before.isNull(), "unavailable").when(F.col("epoch_ms") == before, "duplicate").when(F.col("epoch_ms") < before, "reversed").otherwise("ordered")
    return raw.select("capture_id", "snapshot_index", "timestamp_raw", "epoch_ms", status.alias("ordering_status"), (F.col("epoch_ms") - before).alias("gap_ms"))


def _blocks(marked: DataFrame, wanted: F.Column | None = None) -> DataFrame:
    """Lines of thread blocks (only the `wanted` ones, and those that bound blocks) with their block's header line; a snapshot of any length is cut into buckets of lines."""
    header, stop = F.col("text").rlike(r'^".*"( #\d+|.* tid=0x)'), F.col("text").rlike(r"^(JNI global|Found \w+ Java-level deadlock|Threads class SMR|Full thread dump )")
    cut = carry.latest(F.when(header, F.col("line_no")).when(stop, F.lit(-1)))
    marked = marked if wanted is None else marked.where(wanted | header | stop)
    return carry.carried(marked, ["capture_id", "snapshot_index"], carry.stretch("line_no"), ["line_no"], carry.WHOLE, start_line=cut).where("start_line > 0")


def threads(marked: DataFrame) -> DataFrame:
    """One row per thread block: header fields, the last state line, frames in order."""
    b = _blocks(marked)
    frame = F.when(F.col("text").rlike(r"^\s*at "), F.regexp_replace("text", r"^\s+|\s+$", ""))
    per = b.groupBy("capture_id", "snapshot_index", "start_line").agg(
        F.min_by("text", "line_no").alias("header"),
        F.max_by(F.nullif(F.regexp_extract("text", r"java\.lang\.Thread\.State: ([A-Z_]+)", 1), F.lit("")), F.when(F.col("text").contains("java.lang.Thread.State:"), F.col("line_no"))).alias("java_state"),
        F.transform(F.array_sort(F.collect_list(F.when(frame.isNotNull(), F.struct("line_no", frame.alias("frame"))))), lambda x: x["frame"]).alias("frames"),
        F.max("line_no").alias("end_line"),
    )
    field = lambda p: F.nullif(F.regexp_extract("header", p, 1), F.lit(""))
    in_unit = lambda name, ms: F.regexp_replace(F.coalesce(field(rf"\b{name}=([\d.,]+)(?:ms|s)\b"), F.lit("")), ",", ".").try_cast("double") * F.when(F.col("header").rlike(rf"\b{name}=[\d.,]+ms"), ms).otherwise(ms * 1000)
    return per.select(
        "capture_id", "snapshot_index", field(r'^"(.*)"').alias("thread_name"), field(r'" #(\d+)').alias("jvm_id"), field(r"tid=(0x[0-9a-fA-F]+)").alias("tid"), field(r"nid=(0x[0-9a-fA-F]+|\d+)").alias("nid"),
        F.col("header").rlike(r"\bdaemon\b").alias("daemon"), field(r"\bprio=(\d+)").cast("int").alias("prio"), in_unit("cpu", 1.0).alias("cpu_ms"), (in_unit("elapsed", 1.0) / 1000).alias("elapsed_s"),
        F.coalesce("java_state", F.lit("UNKNOWN")).alias("java_state"), "frames", F.try_element_at("frames", F.lit(1)).alias("top_frame"), "start_line", "end_line",
    ).withColumn("source_key", F.coalesce("tid", "jvm_id", "nid"))


def normalize_frames(frames) -> F.Column:
    """Frames without line numbers, addresses and lambda ids."""
    return F.transform(frames, lambda f: F.regexp_replace(F.regexp_replace(F.regexp_replace(f, r":\d+\)", ")"), r"0x[0-9a-fA-F]+", "0x"), r"Lambda[$/0-9a-fA-Fx.]+", "Lambda"))


def lock_observations(marked: DataFrame) -> DataFrame:
    """One row per lock line of a thread; a wait on an id ends the lexical hold of it; of repeats the last stays."""
    b = _blocks(marked, F.col("text").contains("<0x")).withColumn("lock_id", F.lower(F.regexp_extract("text", r"<(0x[0-9a-fA-F]+)>", 1))).where("lock_id <> ''")
    kind = (
        F.when(F.col("text").contains("- waiting to lock"), "monitor-enter").when(F.col("text").contains("- waiting on"), "monitor-wait")
        .when(F.col("text").contains("- parking to wait for"), "synchronizer-park").when(F.col("text").contains("- locked"), "monitor").when(F.col("text").rlike(r"^\s*- <0x"), "ownable-synchronizer")
    )
    keys = ["capture_id", "snapshot_index", "start_line"]
    seen = b.select(*keys, "lock_id", F.nullif(F.regexp_extract("text", r"\(an? ([^)]+)\)", 1), F.lit("")).alias("lock_type"), kind.alias("kind"), "line_no").where("kind IS NOT NULL")
    last = seen.groupBy(*keys, "lock_id", "kind").agg(F.max_by("lock_type", "line_no").alias("lock_type"), F.max("line_no").alias("line_no"))
    waits = F.bool_or(F.col("kind").isin("monitor-enter", "monitor-wait")).over(Window.partitionBy(*keys, "lock_id"))
    return last.withColumn("_waits", waits).where("kind <> 'monitor' OR NOT _waits").drop("_waits")


HOLDS, CONTENDED = ("monitor", "ownable-synchronizer"), ("monitor-enter", "synchronizer-park")


def relations(locks: DataFrame) -> DataFrame:
    """Per contended wait: observed owners and their resolution (unique, multiple or not observed)."""
    waits = locks.where(F.col("kind").isin(*CONTENDED)).select("capture_id", "snapshot_index", F.col("start_line").alias("waiter"), "lock_id", "kind")
    owners = locks.where(F.col("kind").isin(*HOLDS)).groupBy("capture_id", "snapshot_index", "lock_id").agg(F.count_distinct("start_line").alias("owners"), F.min("start_line").alias("owner"))
    met = waits.join(owners, ["capture_id", "snapshot_index", "lock_id"], "left")
    resolution = F.when(F.col("owners") == 1, "unique-observed-owner").when(F.col("owners") > 1, "multiple-observed-owners").otherwise("owner-not-observed")
    return met.select("capture_id", "snapshot_index", "lock_id", "waiter", "kind", resolution.alias("resolution"), F.when(F.col("owners") == 1, F.col("owner")).alias("owner"))


def contention(locks: DataFrame) -> DataFrame:
    """Per waited lock: distinct owners and waiters."""
    own = F.col("kind").isin(*HOLDS)
    per = locks.groupBy("capture_id", "snapshot_index", "lock_id").agg(F.count_distinct(F.when(own, F.col("start_line"))).alias("owners"), F.count_distinct(F.when(F.col("kind").isin(*CONTENDED), F.col("start_line"))).alias("waiters"))
    return per.where("waiters > 0")


def severity(threads_: DataFrame, locks: DataFrame) -> DataFrame:
    """Lock tier and score per thread: contention 60, blocker min(55, 30 + 10 a waiter), hold 10, none 0."""
    keys = ["capture_id", "snapshot_index", "start_line"]
    rel = relations(locks)
    waits = rel.select("capture_id", "snapshot_index", F.col("waiter").alias("start_line"), F.lit(True).alias("waits")).distinct()
    blocks = rel.where("owner IS NOT NULL").groupBy("capture_id", "snapshot_index", F.col("owner").alias("start_line")).agg(F.count_distinct("lock_id", "waiter").alias("waiters"))
    holds = locks.where(F.col("kind").isin(*HOLDS)).select(*keys, F.lit(True).alias("holds")).distinct()
    t = threads_.select(*keys, "thread_name").join(waits, keys, "left").join(blocks, keys, "left").join(holds, keys, "left")
    tier = F.when(F.col("waits"), "contention").when(F.col("waiters") > 0, "likely-blocker").when(F.col("holds"), "confirmed-hold").otherwise("none")
    score = F.when(F.col("waits"), 60).when(F.col("waiters") > 0, F.least(F.lit(55), 30 + 10 * F.col("waiters"))).when(F.col("holds"), 10).otherwise(0)
    return t.select("capture_id", "snapshot_index", "thread_name", tier.alias("tier"), score.cast("int").alias("score"))


def census(threads_: DataFrame) -> DataFrame:
    return threads_.groupBy("capture_id", "java_state").agg(F.count("*").alias("threads"))


def counter_deltas(rows: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """Change of a counter against the key's row before: baseline, computed, reset or missing; no change is reported as null."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(counter).over(w)
    status = F.when(F.row_number().over(w) == 1, "baseline").when(F.col(counter).isNull() | before.isNull(), "missing").when(F.col(counter) < before, "reset").otherwise("computed")
    return rows.withColumn("status", status).withColumn("delta", F.when(F.col("status") == "computed", F.col(counter) - before))


def runs(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Longest run of consecutive indexes per key."""
    island = rows.select(key, index).distinct().withColumn("_i", F.col(index) - F.row_number().over(Window.partitionBy(key).orderBy(index)))
    return island.groupBy(key, "_i").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest_run"))


def stack_groups(threads_: DataFrame) -> DataFrame:
    """Threads of equal state and normalized frames."""
    return threads_.groupBy("capture_id", "java_state", F.array_join(normalize_frames("frames"), " < ").alias("stack")).agg(F.count("*").alias("threads"))


def lock_roles(locks: DataFrame) -> DataFrame:
    """Per thread: whether it waits for or holds a monitor or a synchronizer."""
    is_ = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    return locks.groupBy("capture_id", "snapshot_index", "start_line").agg(
        is_("monitor-enter").alias("monitor_waiter"), is_("monitor").alias("monitor_holder"), is_("synchronizer-park").alias("synchronizer_waiter"), is_("ownable-synchronizer").alias("synchronizer_holder")
    )


def lock_index(locks: DataFrame) -> DataFrame:
    """Per lock: occurrences, distinct owners, contended and notification waiters, no owner although waited for, category."""
    kind, who = F.col("kind"), F.col("start_line")
    per = locks.groupBy("capture_id", "snapshot_index", "lock_id").agg(
        F.count("*").alias("occurrences"), F.count_distinct(F.when(kind.isin(*HOLDS), who)).alias("owners"), F.count_distinct(F.when(kind.isin(*CONTENDED), who)).alias("contended"),
        F.count_distinct(F.when(kind == "monitor-wait", who)).alias("notified"), F.bool_or(kind.startswith("monitor")).alias("m"), F.bool_or(~kind.startswith("monitor")).alias("s"),
    )
    category = F.when(F.col("m") & F.col("s"), "mixed").when(F.col("m"), "monitor").otherwise("synchronizer")
    return per.withColumn("unresolved", (F.col("contended") > 0) & (F.col("owners") == 0)).withColumn("category", category).drop("m", "s")


def evidence_counts(threads_: DataFrame, locks: DataFrame) -> DataFrame:
    """Per snapshot: blocked, waiting and timed threads, contended waiters, owners, threads that do both, waits without an owner."""
    keys = ["capture_id", "snapshot_index"]
    roles = lock_roles(locks).select(*keys, "start_line", (F.col("monitor_waiter") | F.col("synchronizer_waiter")).alias("waits"), (F.col("monitor_holder") | F.col("synchronizer_holder")).alias("holds"))
    lost = relations(locks).where("resolution = 'owner-not-observed'").select(*keys, F.col("waiter").alias("start_line"), F.lit(True).alias("lost")).distinct()
    all_ = threads_.select(*keys, "start_line", "java_state").join(roles, [*keys, "start_line"], "left").join(lost, [*keys, "start_line"], "left")
    state = lambda s: F.count_if(F.col("java_state") == s)
    return all_.groupBy(*keys).agg(
        state("BLOCKED").alias("blocked"), state("WAITING").alias("waiting"), state("TIMED_WAITING").alias("timed"), F.count_if("waits").alias("contended"), F.count_if("holds").alias("owners"),
        F.count_if(F.col("waits") & F.col("holds")).alias("holding_and_waiting"), F.count_if("lost").alias("unresolved"),
    )


def degrees(threads_: DataFrame, locks: DataFrame) -> DataFrame:
    """Per thread: how many threads it waits for and how many wait for it (single observed owners), and its role."""
    keys = ["capture_id", "snapshot_index", "start_line"]
    edges = relations(locks).where("owner IS NOT NULL").select("capture_id", "snapshot_index", "waiter", "owner").distinct()
    of = lambda end, name: edges.groupBy("capture_id", "snapshot_index", F.col(end).alias("start_line")).agg(F.count("*").alias(name))
    roles = lock_roles(locks).select(*keys, (F.col("monitor_waiter") | F.col("synchronizer_waiter")).alias("waits"), (F.col("monitor_holder") | F.col("synchronizer_holder")).alias("holds"))
    all_ = threads_.select(*keys, "thread_name").join(of("waiter", "depends"), keys, "left").join(of("owner", "blocks"), keys, "left").join(roles, keys, "left")
    waits, holds = F.coalesce("waits", F.lit(False)) | (F.col("depends") > 0), F.coalesce("holds", F.lit(False)) | (F.col("blocks") > 0)
    role = F.when(waits & holds, "waiter-owner").when(waits, "waiter").when(holds, "owner").otherwise("isolated")
    return all_.select(*keys, "thread_name", F.coalesce("depends", F.lit(0)).alias("depends"), F.coalesce("blocks", F.lit(0)).alias("blocks"), role.alias("role"))


def top_locks(locks: DataFrame, n_locks: int = 5, n_waiters: int = 6) -> DataFrame:
    """The most waited locks of each snapshot, and how many of their waiters are beyond those shown."""
    per = relations(locks).groupBy("capture_id", "snapshot_index", "lock_id").agg(F.count_distinct("waiter").alias("waiters"))
    order = Window.partitionBy("capture_id", "snapshot_index").orderBy(F.desc("waiters"), "lock_id")
    shown = per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_locks)
    return shown.withColumn("hidden", F.greatest(F.lit(0), F.col("waiters") - n_waiters))


def line_kind(text) -> F.Column:
    """What a line of a dump is: header, state, frame, lock, section, detail or empty."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    lock = t.startswith("- locked") | t.startswith("- waiting") | t.startswith("- parking")
    section = t.startswith("Locked ownable synchronizers:") | t.rlike(r"^--- .+ ---$")
    return F.when(t == "", "empty").when(t.startswith('"'), "header").when(t.startswith("java.lang.Thread.State:"), "state").when(t.startswith("at "), "frame").when(lock, "lock").when(section, "section").otherwise("detail")


def highlights(frames) -> tuple[F.Column, F.Column]:
    """The first three frames outside the JDK's packages, else the first three; and which of the two they are."""
    jdk = r"^at (\S*/)?(java|javax|jdk|sun|com\.sun)\."
    outside = F.filter(frames, lambda f: ~f.rlike(jdk) & ~F.contains(f, F.lit("$$Lambda")))
    found = F.size(outside) > 0
    return F.slice(F.when(found, outside).otherwise(frames), 1, 3), F.when(found, "outside-jdk-packages").otherwise("first-recorded-frames")


def runtime_info(marked: DataFrame) -> DataFrame:
    """Per snapshot: VM name, version and info of its boundary line; null where the line has no version in brackets."""
    head = marked.where(F.col("text").rlike(_BOUNDARY)).groupBy("capture_id", "snapshot_index").agg(F.min_by("text", "line_no").alias("t"))
    part = lambda n: F.nullif(F.regexp_extract("t", r"^Full thread dump (.*) \(([^\s()]+)\s*([^()]*)\):?\s*$", n), F.lit(""))
    whole = F.regexp_replace(F.regexp_replace("t", _BOUNDARY, ""), r":?\s*$", "")
    return head.select("capture_id", "snapshot_index", F.coalesce(part(1), whole).alias("vm_name"), part(2).alias("vm_version"), part(3).alias("vm_info"))


def deadlock_entries(marked: DataFrame) -> DataFrame:
    """Entries of the JVM's deadlock sections in order; cycle_id counts the sections that have an entry with a holder."""
    keys = ["capture_id", "snapshot_index"]
    found, end = F.col("text").rlike(r"^Found (one|a|\d+) Java-level deadlocks?:"), F.col("text").rlike(r"^Java stack information for the threads listed above:")
    section = carry.latest(F.when(found, F.col("line_no")).when(end, F.lit(-1)))
    inside = carry.carried(marked, keys, carry.stretch("line_no"), ["line_no"], carry.WHOLE, section=section).where("section > 0")
    name = F.nullif(F.regexp_extract("text", r'^"(.*)":\s*$', 1), F.lit(""))
    within = Window.partitionBy(*keys, "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    entry = inside.withColumn("entry_line", F.last(F.when(name.isNotNull(), F.col("line_no")), ignorenulls=True).over(within)).where("entry_line IS NOT NULL")
    last = lambda pattern, n=1: F.max_by(F.regexp_extract("text", pattern, n), F.when(F.col("text").rlike(pattern), F.col("line_no")))
    lock = r"^\s*waiting (?:to lock monitor|for ownable synchronizer) (0x[0-9a-fA-F]+)(?: \(object (0x[0-9a-fA-F]+))?,? ?\(?,?\s*an? ([^),]+)\)?"
    per = entry.groupBy(*keys, "section", "entry_line").agg(F.min_by(name, "line_no").alias("thread_name"), last(lock, 1).alias("monitor"), last(lock, 2).alias("object"), last(lock, 3).alias("waiting_lock_type"), last(r'^\s*(?:which|in JNI, which) is held by "(.*)"').alias("held_by"))
    kept = per.where("held_by IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("section")
    return kept.select(
        *keys, F.dense_rank().over(order).alias("cycle_id"), F.row_number().over(Window.partitionBy(*keys, "section").orderBy("entry_line")).alias("entry_no"), "thread_name",
        F.coalesce(F.nullif("object", F.lit("")), "monitor").alias("waiting_lock_id"), "waiting_lock_type", "held_by",
    )


def deadlock_summary(entries: DataFrame, threads_: DataFrame) -> DataFrame:
    """Per snapshot with a deadlock: cycles, reported entries, and threads whose name only they have and an entry names."""
    keys = ["capture_id", "snapshot_index"]
    single = threads_.groupBy(*keys, "thread_name").agg(F.count("*").alias("times")).where("times = 1").drop("times")
    matched = single.join(entries, [*keys, "thread_name"], "left_semi").groupBy(*keys).agg(F.count("*").alias("matched_threads"))
    counts = entries.groupBy(*keys).agg(F.max("cycle_id").alias("cycles"), F.count("*").alias("entries"))
    return counts.join(matched, keys, "left").withColumn("matched_threads", F.coalesce("matched_threads", F.lit(0)))


def class_initialization(marked: DataFrame) -> DataFrame:
    """Per thread and class: class-initialization-wait (each line) or class-initializer (its first <clinit> frame)."""
    wait = F.nullif(F.regexp_extract("text", r"^\s*- waiting on the Class initialization monitor for (\S+)", 1), F.lit(""))
    init = F.nullif(F.regexp_extract("text", r"^\s*at (?:\S*/)?(\S+)\.<clinit>\(", 1), F.lit(""))
    keys = ["capture_id", "snapshot_index", "start_line"]
    seen = _blocks(marked).select(*keys, "line_no", F.explode(F.array_compact(F.array(F.when(wait.isNotNull(), F.struct(wait.alias("class_name"), F.lit("class-initialization-wait").alias("kind"))), F.when(init.isNotNull(), F.struct(init.alias("class_name"), F.lit("class-initializer").alias("kind")))))).alias("o"))
    return seen.groupBy(*keys, "o.class_name", "o.kind").agg(F.min("line_no").alias("line_no"))


def class_chains(observed: DataFrame, threads_: DataFrame) -> DataFrame:
    """Per waited class: waiters, initializers and status; a lone initializer that waits itself is a stall candidate."""
    keys = ["capture_id", "snapshot_index"]
    states = threads_.select(*keys, "start_line", F.col("java_state").isin("BLOCKED", "WAITING", "TIMED_WAITING").alias("idle"))
    waits = observed.groupBy(*keys, "start_line").agg(F.bool_or(F.col("kind") == "class-initialization-wait").alias("waits"))
    both = observed.join(states, [*keys, "start_line"], "left").join(waits, [*keys, "start_line"]).withColumn("stuck", F.coalesce("idle", F.lit(False)) | F.col("waits"))
    per = both.groupBy(*keys, "class_name").agg(
        F.count_distinct(F.when(F.col("kind") == "class-initialization-wait", F.col("start_line"))).alias("waiters"), F.count_distinct(F.when(F.col("kind") == "class-initializer", F.col("start_line"))).alias("initializers"),
        F.bool_or((F.col("kind") == "class-initializer") & F.col("stuck")).alias("stuck"),
    )
    status = F.when(F.col("initializers") == 0, "initializer-not-observed").when(F.col("initializers") > 1, "ambiguous-initializer").when(F.col("stuck"), "stall-candidate").otherwise("initializing")
    return per.where("waiters > 0").select(*keys, "class_name", "waiters", "initializers", status.alias("status"))


def allocation_bounds(printed) -> F.Column:
    """struct(minimum, maximum, resolution) in bytes of a printed counter: whole units are cut off, fractions may be rounded either way."""
    digits, unit = F.regexp_extract(printed, r"^([0-9]+(?:\.[0-9]+)?) *([KMGTPkmgtp]?)B?$", 1), F.upper(F.regexp_extract(printed, r"^([0-9]+(?:\.[0-9]+)?) *([KMGTPkmgtp]?)B?$", 2))
    scale = F.pow(F.lit(1024.0), F.when(unit != "", F.instr(F.lit("KMGTP"), unit)).otherwise(0))
    decimals = F.length(F.regexp_extract(digits, r"\.([0-9]+)$", 1))
    size = F.round(digits.try_cast("double") * scale)
    resolution = F.greatest(F.lit(1.0), scale * F.pow(F.lit(10.0), -decimals))
    low = F.when(decimals > 0, F.greatest(F.lit(0.0), F.floor(size - resolution))).otherwise(size)
    return F.when(size.isNotNull(), F.struct(low.cast("long").alias("minimum"), (F.ceil(size + resolution) - 1).cast("long").alias("maximum"), resolution.alias("resolution")))


def timestamp_quality(text) -> F.Column:
    """struct(quality, timezone, epoch_ms) of a printed time: missing, invalid or valid; utc, offset or unspecified."""
    shape = r"^\s*([0-9]{4}-[0-9]{2}-[0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]{1,3}))?\s*(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2})?\s*$"
    part = lambda k: F.regexp_extract(text, shape, k)
    clock = F.concat_ws(" ", part(1), part(2)).try_cast("timestamp_ntz")
    zone = part(4)
    minutes = F.regexp_extract(zone, r"([0-9]{2}):?([0-9]{2})", 1).try_cast("int") * 60 + F.regexp_extract(zone, r"([0-9]{2}):?([0-9]{2})", 2).try_cast("int")
    offset = F.coalesce(minutes * F.when(zone.startswith("-"), -1).otherwise(1), F.lit(0)).cast("long") * 60_000
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), clock) + F.coalesce(F.rpad(part(3), 3, "0").try_cast("int"), F.lit(0)) - offset
    quality = F.when(text.isNull() | (F.trim(text) == ""), "missing").when(clock.isNull(), "invalid").otherwise("valid")
    kind = F.when(quality != "valid", None).when(zone.isin("Z", "UTC", "GMT"), "utc").when(zone != "", "offset").otherwise("unspecified")
    return F.struct(quality.alias("quality"), kind.alias("timezone"), millis.alias("epoch_ms"))


def parse_status(marked: DataFrame) -> DataFrame:
    """Per snapshot: threads, lines that look like a header but are none, blocks without state or frames, and success or partial."""
    keys = ["capture_id", "snapshot_index"]
    text = F.col("text")
    torn = marked.groupBy(*keys).agg(F.count_if(text.startswith('"') & ~text.rlike(r'^".*"( #\d+|.* tid=0x)') & ~text.rlike(r'^".*":\s*$')).alias("unparsed"))
    blocks = _blocks(marked).groupBy(*keys, "start_line").agg(F.bool_or(text.contains("java.lang.Thread.State:") | text.rlike(r"^\s*at ")).alias("body"))
    per = blocks.groupBy(*keys).agg(F.count("*").alias("threads"), F.count_if(~F.col("body")).alias("header_only"))
    both = torn.join(per, keys, "left").na.fill(0, ["threads", "header_only"])
    return both.withColumn("status", F.when((F.col("unparsed") > 0) | (F.col("threads") == 0), "partial").otherwise("success"))


def comparable(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Snapshots (status, embedded, scope, segment, process) with whether they can be compared with the one before: both whole, none with mounted virtual threads, and no scope, segment or process that is known to differ."""
    w = Window.partitionBy(key).orderBy(order)
    before = lambda c: F.lag(c).over(w)
    whole = lambda s, e: (F.coalesce(s, F.lit("success")) == "success") & ~F.coalesce(e, F.lit(False))
    same = F.lit(True)
    for c in ("scope", "segment", "process"):
        same = same & F.coalesce(F.col(c) == before(c), F.lit(True))
    return rows.withColumn("comparable", (F.row_number().over(w) > 1) & whole(F.col("status"), F.col("embedded")) & whole(before("status"), before("embedded")) & same)


def waits_for_http(frames, state) -> F.Column:
    """Whether a waiting thread's frames hold a park, below it CompletableFuture.get, below it HttpClientImpl.send."""
    method = F.transform(frames, lambda f: F.regexp_replace(F.regexp_replace(f, r"\(.*$", ""), r"^at (\S*/)?", ""))
    park = F.array_position(F.transform(method, lambda m: m.rlike(r"^(jdk\.internal\.misc\.Unsafe|sun\.misc\.Unsafe|java\.util\.concurrent\.locks\.LockSupport)\.park(Nanos|Until)?$")), True)
    future, send = F.array_position(method, "java.util.concurrent.CompletableFuture.get"), F.array_position(method, "jdk.internal.net.http.HttpClientImpl.send")
    return state.isin("WAITING", "TIMED_WAITING") & (park > 0) & (future > park) & (send > future)


def source_lines(marked: DataFrame, threads_: DataFrame) -> DataFrame:
    """threads with local_line, the place of their header inside their snapshot, beside start_line, that in the file."""
    keys = ["capture_id", "snapshot_index"]
    first = marked.groupBy(*keys).agg(F.min("line_no").alias("first_line"))
    return threads_.join(first, keys).withColumn("local_line", F.col("start_line") - F.col("first_line") + 1)


def thread_evidence(threads_: DataFrame, locks: DataFrame, classes: DataFrame | None = None, deadlocked: DataFrame | None = None) -> DataFrame:
    """threads with what filters and orders read: lock roles, waiters blocked by them, unresolved waits, class initialization, deadlock."""
    keys = ["capture_id", "snapshot_index", "start_line"]
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    roles = lock_roles(locks).join(locks.groupBy(*keys).agg(has("monitor-wait").alias("notified")), keys)
    waits = locks.where(F.col("kind").isin(*CONTENDED)).select("capture_id", "snapshot_index", "lock_id", F.col("start_line").alias("waiter"))
    holds = locks.where(F.col("kind").isin(*HOLDS)).select(*keys, "lock_id")
    blocks = waits.join(holds, ["capture_id", "snapshot_index", "lock_id"]).groupBy(*keys).agg(F.count_distinct("waiter").alias("blocked_waiters"))
    lost = relations(locks).where("resolution = 'owner-not-observed'").select("capture_id", "snapshot_index", F.col("waiter").alias("start_line"), F.lit(True).alias("unresolved")).distinct()
    out = threads_.join(roles, keys, "left").join(blocks, keys, "left").join(lost, keys, "left")
    if classes is not None:
        out = out.join(classes.groupBy(*keys).agg(has("class-initialization-wait").alias("class_wait"), has("class-initializer").alias("class_initializer")), keys, "left")
    else:
        out = out.withColumn("class_wait", F.lit(False)).withColumn("class_initializer", F.lit(False))
    out = out.join(deadlocked.select(*keys, F.lit(True).alias("deadlocked")).distinct(), keys, "left") if deadlocked is not None else out.withColumn("deadlocked", F.lit(False))
    flags = ("monitor_waiter", "monitor_holder", "synchronizer_waiter", "synchronizer_holder", "notified", "unresolved", "class_wait", "class_initializer", "deadlocked")
    return out.na.fill(0, ["blocked_waiters"]).select(*threads_.columns, "blocked_waiters", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def block_filters() -> dict[str, F.Column]:
    """Named predicates over `thread_evidence`; the neighbourhood of one lock is a semi join on `lock_neighbourhood`."""
    c = F.col
    contended = c("monitor_waiter") | c("synchronizer_waiter")
    holds = c("monitor_holder") | c("synchronizer_holder")
    blocked = c("java_state") == "BLOCKED"
    classes = c("class_wait") | c("class_initializer")
    return {
        "everything": F.lit(True), "problems": c("deadlocked") | classes | blocked | contended | (c("blocked_waiters") > 0), "contended": contended | (c("blocked_waiters") > 0), "deadlocks": c("deadlocked"),
        "blocked": blocked, "holders": holds, "holding-and-waiting": contended & holds, "monitor-enter": c("monitor_waiter"), "monitor-holders": c("monitor_holder"),
        "synchronizer-wait": c("synchronizer_waiter"), "synchronizer-holders": c("synchronizer_holder"), "notification-wait": c("notified"), "class-initialization": classes, "unresolved": c("unresolved"),
    }


def lock_neighbourhood(locks: DataFrame, lock_id: str) -> DataFrame:
    """Threads that hold or wait for one lock."""
    return locks.where(F.lower("lock_id") == lock_id.strip().lower()).select("capture_id", "snapshot_index", "start_line").distinct()


def evidence_order(evidence: DataFrame) -> DataFrame:
    """`thread_evidence` with its priority class (0 to 7) and place in its snapshot: class, then name, then source key."""
    f = block_filters()
    contended = F.col("monitor_waiter") | F.col("synchronizer_waiter")
    priority = (
        F.when(F.col("deadlocked"), 0).when(F.col("class_initializer"), 1).when(F.col("class_wait"), 2).when(f["blocked"], 3).when(contended, 4).when(F.col("blocked_waiters") > 0, 5).when(f["holding-and-waiting"], 6).otherwise(7)
    )
    rows = evidence.withColumn("priority", priority)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("capture_id", "snapshot_index").orderBy("priority", "thread_name", "source_key")))


def carriers(marked: DataFrame, threads_: DataFrame) -> DataFrame:
    """Carrier and mounted virtual thread of a snapshot; null where the id is not that of exactly one thread and one carrier."""
    keys = ["capture_id", "snapshot_index"]
    named = F.nullif(F.regexp_extract("text", r"^\s*Carrying virtual thread #(\d+)", 1), F.lit(""))
    carried = _blocks(marked).withColumn("jvm_id", named).where("jvm_id IS NOT NULL").select(*keys, F.col("start_line").alias("carrier_line"), "jvm_id").distinct()
    carried = carried.withColumn("carriers", F.count("*").over(Window.partitionBy(*keys, "jvm_id")))
    known = threads_.groupBy(*keys, "jvm_id").agg(F.count("*").alias("times"), F.min("start_line").alias("line"))
    one = (F.col("carriers") == 1) & (F.col("times") == 1)
    return carried.join(known, [*keys, "jvm_id"], "left").select(*keys, "carrier_line", "jvm_id", F.when(one, F.col("line")).alias("virtual_line"))


def closed_loops(annotated: DataFrame) -> DataFrame:
    """Per deadlock cycle of annotated entries (waiter_key, holder_key): entries, and whether the walk from the first one passes all and returns.

    Each round moves every cycle's walk by one entry, all cycles at once; rounds follow the longest cycle.
    """
    cycle = ["capture_id", "snapshot_index", "cycle_id"]
    entries = annotated.select(*cycle, "entry_no", "waiter_key", "holder_key", "mapped").checkpoint()
    size = entries.groupBy(*cycle).agg(F.count("*").alias("entries"), F.count_distinct("waiter_key").alias("names"), F.bool_and("mapped").alias("all_mapped"))
    start = entries.where("entry_no = 1").select(*cycle, F.col("waiter_key").alias("first"), F.col("holder_key").alias("at"), F.lit(1).alias("hops")).checkpoint()
    walks = start.where("`at` <> first")
    ended = start.where("`at` = first")
    while walks.take(1):
        step = walks.join(entries.select(*cycle, F.col("waiter_key").alias("at"), F.col("holder_key").alias("next")), [*cycle, "at"]).join(size.select(*cycle, "entries"), cycle)
        moved = step.where("hops < entries").select(*cycle, "first", F.col("next").alias("at"), (F.col("hops") + 1).alias("hops")).checkpoint()
        ended = ended.unionByName(moved.where("`at` = first")).checkpoint()
        walks = moved.where("`at` <> first")
    met = ended.groupBy(*cycle).agg(F.max("hops").alias("hops"))
    closed = F.col("all_mapped") & (F.col("names") == F.col("entries")) & F.coalesce(F.col("hops") == F.col("entries"), F.lit(False))
    return size.join(met, cycle, "left").select(*cycle, "entries", closed.alias("closed"))
