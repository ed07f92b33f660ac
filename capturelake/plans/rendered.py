"""Captures that the queries read, rendered from the events table as pieces (capture_id, us, part, line) in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.operators.generic import cut
from capturelake.sources.captures import numbered

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, the first day of the events table


def _events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).alias("us"), F.round(F.col("value") * 100).cast("long").alias("n"))


HOUR_US = 3_600_000_000
#: Users of a bucket of a dump, whose pieces come in the order of users.
USERS = 10_000


def lines(rows: DataFrame, width: int = HOUR_US) -> DataFrame:
    """capture_id, line_no, text; an hour of a long log is a bucket, and so are USERS users of a long dump (`width`)."""
    return numbered(cut(rows), F.floor(F.col("us") / width), "us", "part", "line")


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("capture_id"), "us", "part", "line")


def gc_logs(events: DataFrame) -> DataFrame:
    """A unified collector log per user."""
    e = _events(events)
    heap = F.format_string("%dM->%dM(100M)", F.col("event_id") % 97 + 1 + F.col("event_id") % 31, F.col("event_id") % 97 + 1)
    body = F.create_map(
        F.lit("view"), F.concat(F.lit("Pause Young (Normal) (G1 Evacuation Pause) "), heap),
        F.lit("purchase"), F.concat(F.lit("Pause Full (System.gc()) "), heap),
        F.lit("signup"), F.concat(F.lit("Pause Remark "), heap),
        F.lit("click"), F.lit("Concurrent Mark Cycle"),
        F.lit("error"), F.lit("Allocation Stall (main)"),
    )[F.col("event_type")]
    done = e.select("user_id", "us", F.lit(1).alias("part"), F.format_string("[%dus][info][gc] GC(%d) %s %dus", F.col("us"), F.col("event_id"), body, F.col("n")).alias("line"))
    start = e.where("event_type = 'click'").select("user_id", (F.col("us") - F.col("n")).alias("us"), F.lit(0).alias("part"), F.format_string("[%dus][info][gc,start] GC(%d) Concurrent Mark Cycle", F.col("us") - F.col("n"), F.col("event_id")).alias("line"))
    return _keyed(done.unionByName(start), "user_id")


def thread_dumps(events: DataFrame) -> DataFrame:
    """A classic thread dump per day: one thread per user seen that day, in the state of the user's last event."""
    e = _events(events).withColumn("day", F.to_date("at"))
    day = e.groupBy("day", "user_id").agg(F.max_by("event_type", "us").alias("kind"), F.count("*").alias("n"), F.sum("n").alias("cpu"))
    state = F.create_map(*[F.lit(x) for x in ("view", "RUNNABLE", "click", "WAITING (parking)", "purchase", "TIMED_WAITING (sleeping)", "signup", "RUNNABLE", "error", "BLOCKED (on object monitor)")])[F.col("kind")]
    block = F.concat(
        F.format_string('"user-%d" #%d%s prio=5 os_prio=0 cpu=%dms elapsed=%dms tid=0x%x nid=0x%x waiting [0x1]\n   java.lang.Thread.State: ', F.col("user_id"), F.col("user_id") + 1, F.when(F.col("user_id") % 4 == 0, " daemon").otherwise(""), F.col("cpu"), F.col("n") * 1000, F.col("user_id") + 4096, F.col("user_id") + 1),
        state,
        F.format_string("\n\tat app.Handler%d.run(Handler.java:%d)\n", F.col("n") % 7, F.col("user_id")),
        F.when(F.col("kind") == "error", F.format_string("\t- waiting to lock <0x%x> (a app.Session)\n", F.expr("user_id div 2"))).otherwise(""),
        F.format_string("\tat app.Main.loop(Main.java:5)\n\t- locked <0x%x> (a app.Session)\n", F.col("user_id")),
    )
    rows = day.select("day", F.col("user_id").alias("us"), F.lit(1).alias("part"), block.alias("line"))
    head = day.select("day").distinct().select("day", F.lit(-1).cast("long").alias("us"), F.lit(0).alias("part"), F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 00:00:00\nFull thread dump OpenJDK 64-Bit Server VM (21.0.1+12 mixed mode):\n")).alias("line"))
    return _keyed(rows.unionByName(head), "day")


def tls_logs(events: DataFrame) -> DataFrame:
    """A handshake debug log per twentieth user id, one thread per user, in compact records."""
    e = _events(events)
    message = F.create_map(*[F.lit(x) for x in ("signup", "Produced ClientHello handshake message", "view", "Consuming ServerHello handshake message", "purchase", "Consuming server Finished handshake message", "click", "Ignore unavailable extension: cookie", "error", "Fatal (HANDSHAKE_FAILURE): Received fatal alert: handshake_failure")])[F.col("event_type")]
    line = F.concat(F.format_string("javax.net.ssl|DEBUG|%x|thread-%d|", F.col("user_id"), F.col("user_id")), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC|Handshake.java:1|"), message, F.format_string(' (\n  "event": "%d"\n)', F.col("event_id")))
    return _keyed(e.select((F.col("user_id") % 20).alias("log"), "us", F.lit(0).alias("part"), line.alias("line")), "log")


def handshakes(events: DataFrame) -> DataFrame:
    """Debug logs with what is negotiated: hello and server messages with bodies, retry requests, Finished in both directions, alerts and several zones."""
    e = _events(events)
    odd, kind = F.col("event_id"), F.col("event_type")
    message = (
        F.when(kind == "signup", "Produced ClientHello handshake message").when(kind == "view", "Consuming ServerHello handshake message")
        .when(kind == "purchase", F.when(odd % 2 == 0, "Produced client Finished handshake message").otherwise("Consuming server Finished handshake message"))
        .when(kind == "click", F.when(odd % 4 == 0, "Consuming HelloRetryRequest handshake message").otherwise("Ignore unavailable extension: cookie"))
        .otherwise(F.when(odd % 3 == 0, "Fatal (HANDSHAKE_FAILURE): no luck").otherwise("Received alert message"))
    )
    body = (
        F.when(kind == "signup", F.format_string('"server_name (0)": {\n  type=host_name (0), value=Host-%d.example\n}', F.col("user_id") % 7))
        .when(kind == "view", F.concat(F.format_string('"server version" : "TLSv1.2",\n"cipher suite" : "TLS_C%d(0x1301)"', odd % 5), F.when(odd % 3 == 0, '\n"selected version": [TLSv1.3]').otherwise("")))
        .when((kind == "error") & (odd % 3 == 1), '"level" : "fatal",\n"description" : "bad_certificate"')
        .when((kind == "error") & (odd % 3 == 2), '"level" : "warning",\n"description" : "close_notify"')
    )
    zone = F.when(odd % 50 == 7, "CST").when(odd % 3 == 1, "CET").when(odd % 3 == 2, "+05:30").otherwise("UTC")
    shift = F.when(zone == "CET", 60).when(zone == "+05:30", 330).otherwise(0)
    clock = F.date_format(F.timestamp_add("MINUTE", shift, F.col("at")), "yyyy-MM-dd HH:mm:ss.SSS")
    line = F.concat_ws("\n", F.concat(F.format_string("javax.net.ssl|DEBUG|%x|thread-%d|", F.col("user_id"), F.col("user_id")), clock, F.lit(" "), zone, F.lit("|Handshake.java:1|"), message), body)
    return _keyed(e.select((F.col("user_id") % 20).alias("log"), "us", F.lit(0).alias("part"), line.alias("line")), "log")


WEEK_US = 7 * 86_400_000_000


def collector_logs(events: DataFrame) -> DataFrame:
    """Collector logs whose uptime starts anew every week, with start banners, starts without gap and pressure lines inside a cycle."""
    e = _events(events)
    us, n, number = F.col("us"), F.col("n"), F.col("event_id")
    began = F.greatest(F.lit(0), us - n)
    heap = F.format_string("%dM->%dM(100M)", number % 97 + 1 + number % 31, number % 97 + 1)
    body = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("Pause Young (Normal) (Allocation Failure) "), heap)).when(F.col("event_type") == "purchase", F.concat(F.lit("Pause Full (System.gc()) "), heap))
        .when(F.col("event_type") == "signup", F.concat(F.lit("Pause Remark "), heap)).when(F.col("event_type") == "click", "Concurrent Mark Cycle").otherwise("Allocation Stall (main)")
    )
    line = lambda at, tags, text: F.concat(F.format_string("[%dus]", at % WEEK_US), F.lit(f"[info][{tags}] "), text)
    named = lambda text: F.concat(F.format_string("GC(%d) ", number), text)
    piece = lambda rows, at, part, text: rows.select("user_id", at.alias("us"), F.lit(part).alias("part"), text.alias("line"))
    done = piece(e, us, 2, line(us, "gc", named(F.concat(body, F.format_string(" %dus", n)))))
    start = piece(e.where("event_type = 'click'"), began, 0, line(began, "gc,start", named(F.lit("Concurrent Mark Cycle"))))
    inside = F.greatest(F.lit(0), us - F.floor(n / 2))
    pressure = piece(e.where("event_type = 'click' AND event_id % 2 = 0"), inside, 1, line(inside, "gc", named(F.lit("To-space exhausted"))))
    banner = piece(e.where("event_type = 'signup'"), us, 1, line(us, "gc,init", F.when(number % 2 == 0, "Using G1").otherwise("Using Parallel")))
    return _keyed(done.unionByName(start).unionByName(pressure).unionByName(banner), "user_id")


def legacy_logs(events: DataFrame) -> DataFrame:
    """Records of the older format over two lines, one for each purchase; those of some events do not close."""
    e = _events(events).where("event_type = 'purchase'")
    seconds = lambda c: F.format_string("%d.%06d", F.floor(c / 1_000_000), c % 1_000_000)
    number = F.col("event_id")
    text = F.concat(
        seconds(F.col("us")), F.format_string(": [Full GC (System.gc()) [PSYoungGen: %dK->0K(2000K)]\n  [ParOldGen: 5K->4K(4000K)] %dK->%dK(6000K), [Metaspace: 1K->1K(2K)], ", number % 500, number % 500 + 5, number % 97 + 4),
        seconds(F.col("n")), F.when(number % 10 == 3, " secs").otherwise(" secs] [Times: user=0.01 sys=0.00, real=0.00 secs]"),
    )
    return _keyed(e.select("user_id", "us", F.lit(0).alias("part"), text.alias("line")), "user_id")


def trouble_dumps(events: DataFrame, by: str = "day") -> DataFrame:
    """Dumps with class initialization, waits in the JDK's HTTP client, allocation counters and deadlock sections; `by` day or month (many snapshots a capture)."""
    e = _events(events).withColumn("day", F.to_date("at"))
    day = e.groupBy("day", "user_id").agg(F.max_by("event_type", "us").alias("kind"), F.count("*").alias("n"), F.sum("n").alias("cpu"))
    user, kind = F.col("user_id"), F.col("kind")
    state = F.when(kind == "click", "WAITING (parking)").when(kind == "purchase", "TIMED_WAITING (sleeping)").otherwise("RUNNABLE")
    frames = (
        F.when(kind == "error", F.format_string("\tat app.Caller.call(Caller.java:1)\n\t- waiting on the Class initialization monitor for app.C%d\n", user % 5))
        .when(kind == "signup", F.format_string("\tat app.C%d.<clinit>(C.java:1)\n", user % 5))
        .when(kind == "click", "\tat jdk.internal.misc.Unsafe.park(java.base@21/Native Method)\n\tat java.util.concurrent.CompletableFuture.get(java.base@21/CompletableFuture.java:1)\n\tat jdk.internal.net.http.HttpClientImpl.send(java.net.http@21/HttpClientImpl.java:2)\n")
        .otherwise(F.format_string("\tat app.Handler%d.run(Handler.java:%d)\n", F.col("n") % 7, user))
    )
    block = F.concat(
        F.format_string('"user-%d" #%d prio=5 os_prio=0 cpu=%dms elapsed=%dms allocated=%s tid=0x%x nid=0x%x waiting [0x1]\n   java.lang.Thread.State: ', user, user + 1, F.col("cpu"), F.col("n") * 1000, F.when(user % 3 == 0, F.format_string("%d.5M", user)).otherwise(F.format_string("%dK", user)), user + 4096, user + 1),
        state, F.lit("\n"), frames, F.lit("\tat app.Main.loop(Main.java:5)\n"),
    )
    head = day.select("day").distinct().select("day", F.lit(-2).cast("long").alias("us"), F.lit(0).alias("part"), F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 00:00:00\nFull thread dump OpenJDK 64-Bit Server VM (21.0.1+12 mixed mode):\n")).alias("line"))
    rows = day.select("day", user.alias("us"), F.lit(1).alias("part"), block.alias("line"))
    a, b = day.where("user_id % 10 = 0").select("day", "user_id"), day.where("user_id % 10 = 1").select("day", (user - 1).alias("user_id"))
    entry = lambda who, held: F.format_string('"user-%d":\n  waiting to lock monitor 0x%x (object 0x%x, a app.Session),\n  which is held by "user-%d"\n', who, who + 1, who + 7, held)
    section = F.concat(F.lit("Found one Java-level deadlock:\n=============================\n"), entry(user, user + 1), entry(user + 1, user), F.lit("\nJava stack information for the threads listed above:\n"))
    locked = a.join(b, ["day", "user_id"]).select("day", (user + 1_000_000).alias("us"), F.lit(2).alias("part"), section.alias("line"))
    all_ = rows.unionByName(head).unionByName(locked)
    if by == "day":
        return _keyed(all_, "day")
    offset = F.date_diff(F.col("day"), F.lit("2024-01-01").cast("date")).cast("long") * 3_600_000_000  # a snapshot is an hour's bucket
    return all_.select(F.date_format("day", "yyyy-MM").alias("capture_id"), (F.col("us") + offset + 10).alias("us"), "part", "line")


def json_dumps(events: DataFrame) -> DataFrame:
    """JSON dumps, one for each user and day: a container for each event type with a thread for each event; some records lack an id."""
    e = _events(events).withColumn("day", F.to_date("at"))
    number = F.col("event_id")
    thread = F.struct(F.when(number % 9 != 4, number.cast("string")).alias("tid"), F.format_string("worker-%d", number % 5).alias("name"), F.lit("RUNNABLE").alias("state"), F.array(F.lit("app.Main.loop(Main.java:5)")).alias("stack"))
    box = e.groupBy("user_id", "day", "event_type").agg(F.array_sort(F.collect_list(thread)).alias("threads"), F.count("*").alias("n"))  # a user's events of one type and day
    box = box.select("user_id", "day", F.struct(F.col("event_type").alias("container"), (F.col("n") + F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("string").alias("threadCount"), "threads").alias("box"))
    dump = box.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.col("box"))).alias("threadContainers"))
    return dump.select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")).alias("capture_id"), F.to_json(F.struct(F.struct("threadContainers").alias("threadDump"))).alias("text"))


def carrier_dumps(events: DataFrame) -> DataFrame:
    """Dumps of a day in which each user's worker carries a virtual thread; that of every fifth user is printed twice."""
    e = _events(events)
    day = e.select(F.to_date("at").alias("day"), "user_id").distinct()
    user = F.col("user_id")
    worker = F.format_string('"worker-%d" #%d prio=5 tid=0x%x nid=0x1 runnable\n   java.lang.Thread.State: RUNNABLE\n   Carrying virtual thread #%d\n', user, user + 1, user + 4096, user + 100_000)
    virtual = F.format_string('"" #%d virtual\n\tat app.Task.run(Task.java:1)\n', user + 100_000)
    head = day.select("day").distinct().select("day", F.lit(-1).cast("long").alias("us"), F.lit(0).alias("part"), F.lit("Full thread dump OpenJDK 64-Bit Server VM (21.0.1+12 mixed mode):\n").alias("line"))
    piece = lambda rows, part, line: rows.select("day", user.alias("us"), F.lit(part).alias("part"), line.alias("line"))
    return _keyed(head.unionByName(piece(day, 1, worker)).unionByName(piece(day, 2, virtual)).unionByName(piece(day.where("user_id % 5 = 0"), 3, virtual)), "day")


def synchronization_dumps(events: DataFrame) -> DataFrame:
    """Dumps of a day whose threads wait in twelve ways (user modulo twelve) on locks that a dozen of users share."""
    e = _events(events)
    day = e.groupBy(F.to_date("at").alias("day"), "user_id").agg(F.max_by("event_type", "us").alias("kind"))
    user, kind, dozen = F.col("user_id"), F.col("kind"), F.floor(F.col("user_id") / 12)
    state = F.when(kind == "click", "WAITING (parking)").when(kind == "purchase", "TIMED_WAITING (sleeping)").otherwise("RUNNABLE")
    at = lambda *methods: F.lit("".join(f"\tat {m}(X.java:1)\n" for m in methods))
    lock = lambda text, base, kind: F.format_string(f"\t- {text}<0x%x> (a {kind})\n", dozen + base)
    juc = "java.base@21/java.util.concurrent."
    parks, owned = "parking to wait for  ", lambda base, kind: F.concat(F.lit("\n   Locked ownable synchronizers:\n"), lock("", base, kind))
    rw, rl = "java.util.concurrent.locks.ReentrantReadWriteLock$NonfairSync", "java.util.concurrent.locks.ReentrantLock$NonfairSync"
    body = F.element_at(
        F.array(
            F.concat(at(f"{juc}locks.LockSupport.park"), lock(parks, 0xC000, "java.util.concurrent.locks.AbstractQueuedSynchronizer$ConditionObject"), at(f"{juc}locks.AbstractQueuedSynchronizer$ConditionObject.await")),
            at(f"{juc}locks.AbstractQueuedSynchronizer.acquireSharedInterruptibly", f"{juc}CountDownLatch.await"),
            F.concat(at("java.base@21/java.lang.Object.wait0"), lock("waiting on ", 0xD000, "app.Queue"), at("java.base@21/java.lang.Object.wait")),
            F.concat(lock(parks, 0xB000, rw), at(f"{juc}locks.ReentrantReadWriteLock$ReadLock.lock")),
            at(f"{juc}locks.ReentrantReadWriteLock$WriteLock.lock"),
            F.concat(at("java.base@21/java.lang.Thread.sleep"), owned(0xB000, rw)),
            at(f"{juc}locks.ReentrantReadWriteLock$Sync.tryAcquire"),
            F.concat(at("java.base@21/java.lang.Thread.sleep"), owned(0xA000, rl)),
            F.concat(at(f"{juc}locks.LockSupport.park"), lock(parks, 0xA000, rl), at(f"{juc}locks.ReentrantLock.lock")),
            F.concat(at("app.Other.call"), lock(parks, 0xA000, rl)),
            at("java.base@21/sun.nio.ch.EPollSelectorImpl.doSelect"),
            at("app.Main.loop"),
        ),
        (user % 12).cast("int") + 1,
    )
    block = F.concat(F.format_string('"user-%d" #%d prio=5 tid=0x%x nid=0x1 runnable\n   java.lang.Thread.State: ', user, user + 1, user + 4096), state, F.lit("\n"), body)
    head = day.select("day").distinct().select("day", F.lit(-1).cast("long").alias("us"), F.lit(0).alias("part"), F.lit("Full thread dump OpenJDK 64-Bit Server VM (21.0.1+12 mixed mode):\n").alias("line"))
    return _keyed(head.unionByName(day.select("day", user.alias("us"), F.lit(1).alias("part"), block.alias("line"))), "day")


def mixed_handshakes(events: DataFrame) -> DataFrame:
    """Debug logs of a user in three formats: compact records, records of one field a line, and blocks of the oldest format."""
    e = _events(events)
    kind, number = F.col("event_type"), F.col("event_id")
    clock = F.concat(F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" UTC"))
    head = lambda message: F.concat(F.format_string("javax.net.ssl|DEBUG|%x|worker|", F.col("user_id")), clock, F.lit(f"|X.java:1|{message}"))
    line = (
        F.when(kind == "signup", F.concat(head("Produced ClientHello handshake message (\n"), F.lit('"ClientHello": {\n}\n)')))
        .when(kind == "view", F.concat(F.format_string('{\n  "logger"     : "javax.net.ssl",\n  "level"      : "DEBUG",\n  "thread id"  : "%x",\n  "thread name": "worker",\n  "time"       : "', F.col("user_id")), clock, F.lit('",\n  "message"    : "Ignore unavailable extension",\n  "specifics"  : []\n}')))
        .when(kind == "purchase", F.concat(F.format_string("main, %s: TLSv1.2 Handshake, length = 9\n*** Finished", F.when(number % 2 == 0, "READ").otherwise("WRITE")), F.when(number % 3 == 0, "\nverify_data:  { 1, 2 }\n***").otherwise("")))
        .when(kind == "click", F.concat(head("Consuming CertificateRequest handshake message (\n"), F.format_string('"certificate authorities": [\n  "CN=[root %d], O=\\"x\\"",\n  "CN=Common\\, Root", "CN=[root %d], O=\\"x\\""]\n)', number % 3, number % 3)))
        .otherwise(F.concat(head("Produced client Certificate handshake message (\n"), F.format_string('  "subject"            : "O=a, CN=\\"client, %d\\", C=SE",\n  "subject" : "CN=issuer"\n)', number % 5)))
    )
    return _keyed(e.select("user_id", "us", F.lit(0).alias("part"), line.alias("line")), "user_id")


def ring_dumps(events: DataFrame) -> DataFrame:
    """Dumps of a day in which each three users form a ring: a thread holds its own lock and may wait for the next one's, or
    for the class that the next one initializes."""
    e = _events(events)
    day = e.groupBy(F.to_date("at").alias("day"), "user_id").agg(F.max_by("event_type", "us").alias("kind"))
    user, kind = F.col("user_id"), F.col("kind")
    after = F.floor(user / 3) * 3 + (user + 1) % 3
    wait = F.when(kind.isin("error", "click"), F.format_string("\t- waiting to lock <0x%x> (a app.Session)\n", after + 256)).when(kind == "signup", F.format_string("\t- waiting on the Class initialization monitor for app.C%d\n", after)).otherwise("")
    block = F.concat(
        F.format_string('"user-%d" #%d prio=5 tid=0x%x nid=0x1 runnable\n   java.lang.Thread.State: RUNNABLE\n\tat app.A.b(A.java:1)\n', user, user + 1, user + 4096), wait,
        F.format_string("\tat app.C%d.<clinit>(C.java:1)\n\t- locked <0x%x> (a app.Session)\n", user, user + 256),
    )
    head = day.select("day").distinct().select("day", F.lit(-1).cast("long").alias("us"), F.lit(0).alias("part"), F.lit("Full thread dump OpenJDK 64-Bit Server VM (21.0.1+12 mixed mode):\n").alias("line"))
    return _keyed(head.unionByName(day.select("day", user.alias("us"), F.lit(1).alias("part"), block.alias("line"))), "day")
