"""Capture text as tables: files and lines, the ingest gate, evidence ranges, JSON dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.operators import carry, generic

MAX_BYTES = 64 * 1024 * 1024


def gate(content) -> F.Column:
    """Why a file's bytes are kept out (empty, too large, compressed, binary, not UTF-8); null where they are not."""
    return (
        F.when(F.length(content) == 0, "empty")
        .when(F.length(content) > MAX_BYTES, "too large")
        .when(F.hex(F.substring(content, 1, 2)) == "1F8B", "compressed")
        .when(F.position(F.lit(b"\x00"), content) > 0, "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """capture_id, path, bytes, sha256, reason, text: text is null where a reason keeps the file out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    gated = raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), gate(F.col("content")).alias("reason"), F.col("content").cast("string").alias("text"))
    return gated.select(F.sha2("path", 256).substr(1, 16).alias("capture_id"), "path", "bytes", "sha256", "reason", F.when(F.col("reason").isNull(), F.col("text")).alias("text"))


def duplicates(captures: DataFrame) -> DataFrame:
    """Paths met more than once, and whether their contents differ."""
    return captures.groupBy("path").agg(F.count("*").alias("times"), (F.count_distinct("sha256") > 1).alias("conflict")).where("times > 1")


def numbered(pieces: DataFrame, bucket: F.Column, *order: str) -> DataFrame:
    """capture_id, line_no, text of pieces (capture_id, order columns, line: one or more lines) without gathering a capture.

    The bucket is a whole number that grows with the order: lines are numbered in many tasks, whatever a capture's length.
    """
    each = pieces.select("capture_id", bucket.cast("long").alias("part_of"), *order, F.posexplode(F.split("line", "\n")).alias("pos", "text"))
    return carry.numbered(each, ["capture_id"], F.col("part_of"), [*order, "pos"], most=carry.WHOLE).select("capture_id", F.col("place").cast("int").alias("line_no"), "text")


def lines(captures: DataFrame) -> DataFrame:
    """capture_id, line_no (from 1), text: CRLF and CR count as LF, a byte order mark goes."""
    clean = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\r\n?", "\n")
    return captures.where("text IS NOT NULL").select("capture_id", F.posexplode(F.split(clean, "\n"))).select("capture_id", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"))


def ranges(all_lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of wanted ranges (capture_id, first_line, last_line), which are few for a capture."""
    return all_lines.join(wanted, "capture_id").where("line_no BETWEEN first_line AND last_line").select("capture_id", "first_line", "last_line", "line_no", "text")


def checked_ranges(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of any number of wanted ranges (capture_id, sha256, first_line, last_line); fails where a capture is gone or its text has another hash."""
    now = captures.where("text IS NOT NULL").select("capture_id", "text", F.sha2("text", 256).alias("_now"))
    asked = wanted.select("capture_id", "sha256").distinct().join(now, "capture_id", "left")
    changed = F.raise_error(F.concat(F.lit("capture changed: "), F.col("capture_id"))).cast("string")
    all_lines = lines(asked.withColumn("text", F.when(F.col("_now").eqNullSafe(F.col("sha256")), F.col("text")).otherwise(changed)))
    asked = wanted.select("capture_id", "first_line", "last_line").distinct().join(all_lines.groupBy("capture_id").agg(F.max("line_no").alias("_n")), "capture_id")
    asked = asked.withColumn("first_line_", F.greatest("first_line", F.lit(1))).withColumn("last_line_", F.least("last_line", "_n")).where("first_line_ <= last_line_")
    numbers = asked.select("capture_id", "first_line", "last_line", F.explode(F.sequence("first_line_", "last_line_")).alias("line_no"))
    return numbers.join(all_lines, ["capture_id", "line_no"]).select("capture_id", "first_line", "last_line", "line_no", "text")


#: Lines of a leaf of a hash tree, children of a node above, and levels above the leaves: room for 10 ** 12 lines.
LEAF, FAN, HEIGHT = 1_000, 1_000, 3


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """capture_id, line_no, text of text files of any size: each split is read where it lies and no file is one string.

    Splits tell where they begin, so lines are numbered split by split and the counts of splits before are added.
    """
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.sha2(F.col("_metadata.file_path"), 256).substr(1, 16).alias("capture_id"), F.col("_metadata.file_block_start").alias("begins"), F.monotonically_increasing_id().alias("within"), F.col("value").alias("text"))
    first = (F.col("begins") == 0) & (F.col("line_no") == 1)
    placed = carry.numbered(raw, ["capture_id"], F.floor(F.col("begins") / (1 << 20)).cast("long"), ["begins", "within"], "line_no")
    return placed.select("capture_id", F.col("line_no").cast("int").alias("line_no"), F.when(first, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")).alias("text"))


def _leaves(numbered_lines: DataFrame) -> DataFrame:
    block = F.floor((F.col("line_no") - 1) / LEAF).cast("long")
    own = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return numbered_lines.groupBy("capture_id", block.alias("node")).agg(F.sha2(F.concat(F.count("*").cast("string"), F.lit("\n"), F.array_join(own, "\n", "")), 256).alias("digest"))


def _above(nodes: DataFrame) -> DataFrame:
    children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
    return nodes.groupBy("capture_id", F.floor(F.col("node") / FAN).cast("long").alias("above")).agg(F.sha2(F.array_join(children, ""), 256).alias("digest")).withColumnRenamed("above", "node")


def hash_tree(numbered_lines: DataFrame) -> DataFrame:
    """capture_id, level (0: LEAF lines), node, digest; the node of level HEIGHT stands for the whole capture.

    A task holds one leaf's lines or one node's children at a time. The leaves are written once.
    """
    level = generic.cut(_leaves(numbered_lines))
    tree = level.select("capture_id", F.lit(0).alias("level"), "node", "digest")
    for k in range(1, HEIGHT + 1):
        level = _above(level)
        tree = tree.unionByName(level.select("capture_id", F.lit(k).alias("level"), "node", "digest"))
    return tree


def roots(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("level") == HEIGHT).select("capture_id", F.col("digest").alias("root"))


def proved_ranges(numbered_lines: DataFrame, tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of wanted ranges (capture_id, root, first_line, last_line); fails where a capture is gone or was changed.

    Only the leaves that a range touches are hashed again; their digests must be those of the tree, those of each node
    above must be the hash of its children's, and the topmost must be the root that is asked for. So a change of a line
    in a range, of the tree, or another root is found without the rest of the capture's text.
    """
    wanted = wanted.select("capture_id", "root", "first_line", "last_line").distinct()
    cell = lambda c: F.floor((c - 1) / LEAF).cast("long")
    asked = wanted.withColumn("from", F.greatest("first_line", F.lit(1))).where("`from` <= last_line")
    asked = asked.join(numbered_lines.groupBy("capture_id").agg(F.max("line_no").alias("_n")), "capture_id", "left").withColumn("to", F.least("last_line", F.coalesce("_n", F.lit(1)))).where("`from` <= `to`")
    parts = asked.select("capture_id", "root", "first_line", "last_line", "from", "to", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))).alias("node"))
    touched = parts.select("capture_id", "node").distinct()
    by_block = numbered_lines.withColumn("node", cell(F.col("line_no"))).join(touched, ["capture_id", "node"], "left_semi")
    level, again, checks = touched, _leaves(by_block), None
    for k in range(HEIGHT + 1):
        stored = tree.where(F.col("level") == k).select("capture_id", "node", "digest")
        met = level.join(stored.withColumnRenamed("digest", "stored"), ["capture_id", "node"], "left").join(again, ["capture_id", "node"], "left")
        check = met.groupBy("capture_id").agg(F.bool_and(F.coalesce(F.col("stored") == F.col("digest"), F.lit(False))).alias("whole"))
        checks = check if checks is None else checks.unionByName(check)
        level = level.select("capture_id", F.floor(F.col("node") / FAN).cast("long").alias("node")).distinct()
        again = _above(stored.withColumn("above", F.floor(F.col("node") / FAN).cast("long")).join(level.withColumnRenamed("node", "above"), ["capture_id", "above"], "left_semi").drop("above"))
    proof = checks.groupBy("capture_id").agg(F.bool_and("whole").alias("whole")).join(roots(tree).withColumnRenamed("root", "_root"), "capture_id", "left")
    sure = F.coalesce(F.col("whole") & (F.col("_root") == F.col("root")), F.lit(False))
    changed = F.raise_error(F.concat(F.lit("capture changed: "), F.col("capture_id"))).cast("boolean")
    judged = parts.join(proof, "capture_id", "left").withColumn("sure", sure)
    # a range meets its own lines by number, not all lines of its leaves
    head, tail = F.col("node") * LEAF + 1, (F.col("node") + 1) * LEAF
    numbers = judged.where("sure").select("capture_id", "first_line", "last_line", F.explode(F.sequence(F.greatest("from", head), F.least("to", tail)).cast("array<int>")).alias("line_no"))
    found = numbers.join(by_block.select("capture_id", "line_no", "text"), ["capture_id", "line_no"]).select("capture_id", "first_line", "last_line", "line_no", "text")
    # a branch of its own, which has no rows or fails: a join with lines that are gone would never look at it
    failed = judged.where(F.when(F.col("sure"), False).otherwise(changed)).select("capture_id", "first_line", "last_line", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("text"))
    return found.unionByName(failed)


#: Schema of JSON thread dumps; ids may be numbers or strings there.
JSON_DUMP = (
    "threadDump struct<processId: string, time: string, runtimeVersion: string, threadContainers: array<struct<container: string, parent: string, owner: string, threadCount: string,"
    "threads: array<struct<tid: string, name: string, state: string, virtual: boolean, stack: array<string>>>>>>"
)


def json_threads(captures: DataFrame) -> DataFrame:
    """One row per thread record of JSON dumps; records without an id or name are invalid."""
    dump = captures.select("capture_id", F.from_json("text", JSON_DUMP)["threadDump"].alias("d"))
    box = dump.select("capture_id", F.posexplode("d.threadContainers").alias("box_no", "box"))
    each = box.select("capture_id", "box_no", F.col("box.container").alias("container"), F.expr("try_cast(box.threadCount AS INT) > size(box.threads)").alias("incomplete"), F.posexplode("box.threads").alias("thread_no", "t"))
    return each.select("capture_id", "box_no", "container", "incomplete", "thread_no", "t.tid", "t.name", "t.state", "t.virtual", "t.stack", (F.col("t.tid").isNotNull() & F.col("t.name").isNotNull()).alias("valid"))
