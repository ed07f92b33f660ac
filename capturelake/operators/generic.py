"""Operations that take column names and serve any table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpoint_folder(context: SparkContext) -> str:
    """The folder named by the session. A cluster must name one; a local master, all in one process, may use a temporary one."""
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder and read again, so that the plan of a loop does not grow and a lost executor costs no round."""
    path = f"{checkpoint_folder(df.sparkSession.sparkContext)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_of(states: DataFrame, wanted: DataFrame, key: str, since: str, at: str, value: str) -> DataFrame:
    """Per wanted (key, at): the value of the latest state with since <= at; null where there is none."""
    met = wanted.join(states.select(key, since, value), key, "left").where(F.col(since).isNull() | (F.col(since) <= F.col(at)))
    best = met.groupBy(key, at).agg(F.max_by(value, F.struct(since, value)).alias(value))
    return wanted.join(best, [key, at], "left")


def changed_between(states: DataFrame, key: str, since: str, value: str, first, second) -> DataFrame:
    """Keys whose as-of value differs between two points."""
    of = lambda p: F.max_by(value, F.when(F.col(since) <= p, F.struct(since, value)))
    return states.groupBy(key).agg(of(first).alias("before"), of(second).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def top_with_mandatory(rows: DataFrame, group: str, order: list, n: int, mandatory) -> DataFrame:
    """The first n rows of each group, and every mandatory row."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where((F.col("rank") <= n) | mandatory)


def union_of_tops(rows: DataFrame, group: str, key: str, first: str, second: str, n: int) -> DataFrame:
    """Rows among the n largest by either measure, nulls last."""
    rank = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.col(c).desc_nulls_last(), key))
    return rows.withColumn("_a", rank(first)).withColumn("_b", rank(second)).where((F.col("_a") <= n) | (F.col("_b") <= n)).drop("_a", "_b")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold every word of the query, scored by occurrences."""
    wanted = sorted({w for w in query.lower().split() if w})
    found = docs.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).where(F.col("word").isin(wanted))
    return found.groupBy(key).agg(F.count("*").alias("score"), F.count_distinct("word").alias("words")).where(F.col("words") == len(wanted)).select(key, "score")


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts per bucket of fixed edges; nulls are skipped, empty buckets dropped."""
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col(value) >= e).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reach(edges: DataFrame) -> DataFrame:
    """All (source, target) pairs joined by a path of (source, target) edges; each round extends only the pairs it has just found.

    Rounds go on until a round finds no pair, so any length of path is followed. The result itself may hold a pair for
    every two nodes of a component: use `in_cycles` or `depths` where pairs are not wanted.
    """
    edges = cut(edges.select("source", "target").distinct())  # each round reads them again
    known = fresh = edges
    while True:
        step = fresh.alias("f").join(edges.alias("e"), F.col("f.target") == F.col("e.source")).select("f.source", "e.target").distinct()
        fresh = cut(step.join(known, ["source", "target"], "left_anti"))
        if not fresh.take(1):
            return known
        known = cut(known.unionByName(fresh))


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest label that reaches a node along edges (source, target), its own included; null is none."""
    while True:
        sent = edges.join(labels.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("met"))
        new = cut(labels.join(sent, "node", "left").select("node", F.least("label", "met").alias("label"), F.coalesce(F.col("met") < F.col("label"), F.col("met").isNotNull()).alias("moved")))
        if not new.where("moved").take(1):
            return new.drop("moved")
        labels = new.drop("moved")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the strongly connected component of every node, named by its smallest member.

    Nodes without an edge in or out of the rest are components of their own and leave, again and again. Then each node
    takes the smallest label that reaches it; those that their label's node is reached by, inside the same label, are its
    component and leave too; edges between labels fall away. Rows in memory never exceed nodes and edges.
    """
    edges = cut(edges.select("source", "target").distinct())
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    done, left = [], cut(edges.where("source <> target"))
    while True:
        while True:
            both = left.select(F.col("source").alias("node")).distinct().join(left.select(F.col("target").alias("node")).distinct(), "node")
            kept = cut(left.join(both.withColumnRenamed("node", "source"), "source", "left_semi").join(both.withColumnRenamed("node", "target"), "target", "left_semi"))
            if kept.count() == left.count():
                break
            left = kept
        if not left.take(1):
            break
        inner = left.select(F.col("source").alias("node")).distinct()
        forward = cut(_spread(inner.withColumn("label", F.col("node")), left))
        a, b = forward.withColumnsRenamed({"node": "source", "label": "label_a"}), forward.withColumnsRenamed({"node": "target", "label": "label_b"})
        own = cut(left.join(a, "source").join(b, "target").where("label_a = label_b").select("source", "target"))
        back = own.select(F.col("target").alias("source"), F.col("source").alias("target"))
        start = forward.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"))
        found = cut(_spread(start, back).alias("b").join(forward.alias("f"), "node").where("b.label = f.label").select("node", F.col("f.label").alias("component")))
        done.append(found)
        left = cut(own.join(found.withColumnRenamed("node", "source"), "source", "left_anti").join(found.withColumnRenamed("node", "target"), "target", "left_anti"))
    found = done[0] if done else nodes.select("node", F.col("node").alias("component")).limit(0)
    for more in done[1:]:
        found = found.unionByName(more)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def in_cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle, self loops included: those of components with several members, and those with an edge to themselves."""
    parts = strong_components(edges)
    several = parts.groupBy("component").count().where("count > 1").select("component")
    return parts.join(several, "component", "left_semi").select("node").union(edges.where("source = target").select(F.col("source").alias("node"))).distinct()


def depths(edges: DataFrame) -> DataFrame:
    """Longest path length from each node over the graph whose cycles are drawn together; nodes of one cycle share it.

    Rounds follow the longest path; since the condensed graph has no cycle they end.
    """
    edges = cut(edges.select("source", "target").distinct())
    parts = cut(strong_components(edges))
    a, b = parts.withColumnsRenamed({"node": "source", "component": "from"}), parts.withColumnsRenamed({"node": "target", "component": "to"})
    links = cut(edges.join(a, "source").join(b, "target").where("`from` <> `to`").select("from", "to").distinct())
    level = cut(parts.select(F.col("component").alias("node")).distinct().withColumn("depth", F.lit(0)))
    while True:
        longer = links.join(level.withColumnsRenamed({"node": "to"}), "to").groupBy(F.col("from").alias("node")).agg((F.max("depth") + 1).alias("d"))
        new = cut(level.join(longer, "node", "left").select("node", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.col("d") > F.col("depth")).alias("moved")))
        level = new.drop("moved")
        if not new.where("moved").take(1):
            return parts.join(level.withColumnRenamed("node", "component"), "component").select("node", "depth")


def ancestor_counts(edges: DataFrame, own: bool = False) -> DataFrame:
    """(node, n): how many other nodes reach each node along edges (source, target), without a table of such pairs.

    With `own` a node on a cycle, a self loop included, counts itself as well.

    Nodes of one cycle reach the same nodes and are drawn together, so what is left has no cycle. A part with one edge out
    has one way on: the sizes of such parts are handed up to the next part with several edges out, a fork, or to an end,
    and added on the way. What a fork gathers is disjoint from what another does, so beyond forks only whole forks are
    told apart: a part counts its own sum and the sums of the different forks that reach it. Rows are nodes and edges, and
    for graphs with forks the forks that reach each part; a thread that waits for one lock of one owner makes none.
    """
    edges = cut(edges.select("source", "target").distinct())
    parts = cut(strong_components(edges))
    sizes = cut(parts.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("size")))
    a, b = parts.withColumnsRenamed({"node": "source", "component": "from"}), parts.withColumnsRenamed({"node": "target", "component": "to"})
    links = cut(edges.join(a, "source").join(b, "target").where("`from` <> `to`").select("from", "to").distinct())
    out = links.groupBy("from").agg(F.count("*").alias("ways"))
    forks = cut(out.where("ways > 1").select(F.col("from").alias("part")))
    single = cut(links.join(out.where("ways = 1"), "from").select("from", "to"))
    # sums of the parts that come up to each part by ways without a choice, rank by rank from the leaves
    sums = cut(sizes.withColumn("gathered", F.col("size")))
    waiting = single
    while waiting.take(1):
        ready = waiting.join(waiting.select(F.col("to").alias("from")).distinct(), "from", "left_anti")
        handed = ready.join(sums.withColumnRenamed("part", "from"), "from").groupBy(F.col("to").alias("part")).agg(F.sum("gathered").alias("more"))
        sums = cut(sums.join(handed, "part", "left").select("part", "size", (F.col("gathered") + F.coalesce("more", F.lit(0))).alias("gathered")))
        waiting = cut(waiting.join(ready.select("from"), "from", "left_anti"))
    # (part, fork): the forks that reach each part; each round goes one edge on from the pairs just found
    met = fresh = cut(links.join(forks.withColumnRenamed("part", "from"), "from").select(F.col("to").alias("part"), F.col("from").alias("fork")).distinct())
    while fresh.take(1):
        on = fresh.join(links.withColumnRenamed("from", "part"), "part").select(F.col("to").alias("part"), "fork").distinct()
        fresh = cut(on.join(met, ["part", "fork"], "left_anti"))
        met = cut(met.unionByName(fresh))
    by_forks = met.join(sums.select(F.col("part").alias("fork"), "gathered"), "fork").groupBy("part").agg(F.sum("gathered").alias("by_forks"))
    per = sums.join(by_forks, "part", "left").select(F.col("part").alias("component"), (F.col("gathered") + F.coalesce("by_forks", F.lit(0)) - 1).alias("n"))
    counted = parts.join(per, "component")
    if not own:
        return counted.select("node", "n")
    loops = edges.where("source = target").select(F.col("source").alias("node"), F.lit(True).alias("loop"))
    turns = counted.join(sizes.select(F.col("part").alias("component"), "size"), "component").join(loops, "node", "left")
    return turns.select("node", (F.col("n") + F.when((F.col("size") > 1) | F.col("loop"), 1).otherwise(0)).alias("n"))


def set_sides(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of two tables: gone (only before), appeared (only after) or both."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(1)), after.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "appeared").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def find_literal(rows: DataFrame, text: str, query: str) -> DataFrame:
    """One row per occurrence of a literal, whatever its case, with its offset from 0; occurrences do not overlap.

    The gaps between occurrences are summed by a window over a row's own gaps, so work is linear in the text.
    """
    wanted = query.lower()
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in wanted)
    gaps = F.transform(F.split(F.lower(text), quoted, -1), lambda x: F.length(x))
    found = rows.where(F.contains(F.lower(text), F.lit(wanted))).withColumn("_row", F.monotonically_increasing_id())
    order = Window.partitionBy("_row").orderBy("_pos")
    end = F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_pos") * len(wanted)
    each = found.select("*", F.posexplode(gaps).alias("_pos", "_gap")).withColumn("offset", end.cast("int")).withColumn("_rest", F.lead("_pos").over(order).isNull())
    return each.where("NOT _rest").select(*rows.columns, "offset")


def query_words(query: str) -> list[str]:
    """Distinct words of a query in order."""
    return list(dict.fromkeys(re.findall(r"\w+", query.lower())))


def _hits(words, wanted: str):
    """How a word list meets a query word: as a part of a word, a number only whole."""
    return F.exists(words, (lambda w: w == wanted) if wanted.isdigit() else (lambda w: F.contains(w, F.lit(wanted))))


def weighted_search(docs: DataFrame, query: str, key: str, title: str, terms: str, body: str) -> DataFrame:
    """Documents in which every query word occurs: 8 for each in the title, else 4 in the terms, else 1, and 100 for the whole query in the title."""
    wanted = query_words(query)
    listed = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    rows = docs.select(key, F.lower(F.coalesce(title, F.lit(""))).alias("_t"), listed(title).alias("_a"), listed(terms).alias("_b"), listed(body).alias("_c"))
    weights = [F.when(_hits("_a", w), 8).when(_hits("_b", w), 4).when(_hits("_c", w), 1) for w in wanted]
    if not wanted:
        return rows.select(key, F.lit(0).alias("score")).limit(0)
    score = sum(weights, F.when(F.contains("_t", F.lit(query.lower().strip())), 100).otherwise(0))
    return rows.select(key, score.alias("score")).where("score IS NOT NULL")


def word_hits(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, start, end, word): where query words occur in a text, numbers only as whole words, each word's hits apart from each other.

    Offsets count characters from 0; ends are exclusive.
    """
    found = docs.select(key, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("word")).limit(0)
    for w in query_words(query):
        pattern = "(?iu)" + (rf"(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])" if w.isdigit() else w)
        gaps = F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x))
        hits = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), lambda x: F.length(x))
        each = docs.where(F.col(text).rlike(pattern)).select(F.col(key), F.posexplode(F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))).alias("pos", "x"))
        upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("x.gap") + F.coalesce(F.col("x.hit"), F.lit(0))).over(upto).cast("int")
        ranges = each.select(key, end.alias("end"), F.col("x.hit").alias("hit")).where("hit IS NOT NULL")
        found = found.unionByName(ranges.select(key, (F.col("end") - F.col("hit")).alias("start"), "end", F.lit(w).alias("word")))
    return found


def match_ranges(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, start, end): `word_hits`, overlapping ones as one range."""
    order = Window.partitionBy(key).orderBy("start", F.desc("end"), "word")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = word_hits(docs, key, text, query).withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    return marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def best_excerpt(docs: DataFrame, key: str, text: str, query: str, width: int = 240, lead: int = 65) -> DataFrame:
    """Per document with a match the window of `width` characters, begun `lead` before a match, that holds most different query words, the earliest of such: start, words, excerpt."""
    hits = word_hits(docs, key, text, query)
    starts = hits.select(key, F.greatest(F.lit(0), F.col("start") - lead).alias("from")).distinct()
    # windows meet the hits of their own and the next stretch of `width` characters only
    cell = lambda c: F.floor(c / width)
    near = starts.withColumn("cell", F.explode(F.array(cell(F.col("from")), cell(F.col("from")) + 1)))
    inside = near.join(hits.withColumn("cell", cell(F.col("start"))), [key, "cell"]).where((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("from") + width))
    counted = inside.groupBy(key, "from").agg(F.count_distinct("word").alias("words"))
    best = counted.groupBy(key).agg(F.max_by("from", F.struct("words", -F.col("from"))).alias("from"), F.max("words").alias("words"))
    return docs.join(best, key).select(key, F.col("from").alias("start"), "words", F.substring(F.col(text), F.col("from") + 1, F.lit(width)).alias("excerpt"))


def section_excerpts(sections: DataFrame, key: str, number: str, text: str, query: str, width: int = 240, lead: int = 65, slack: int = 25) -> DataFrame:
    """Per key with a match: number, start, end, words and excerpt of its best section; sections are numbered within a key.

    First the section with most different query words wins (ties: the first one), then inside it the window of `width`
    characters, begun `lead` before a match, with most of them (ties: the earliest). Overlapping matches count as one, by
    the word of the first. Ends inside the text move to a space up to `slack` characters further in, and show an ellipsis.
    """
    rows = sections.where(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("k"), F.col(number).alias("n")).alias("_id"), F.col(text).alias("_t"))
    order = Window.partitionBy("_id").orderBy("start", F.desc("end"))
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = word_hits(rows, "_id", "_t", query).withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hits = cut(marked.groupBy("_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("word", F.struct("start", -F.col("end"))).alias("word")))
    of_section = hits.groupBy("_id").agg(F.count_distinct("word").alias("found"))
    best = of_section.groupBy(F.col("_id.k").alias("k")).agg(F.min_by("_id", F.struct(-F.col("found"), F.col("_id.n"))).alias("_id"))
    own = hits.join(best.select("_id"), "_id", "left_semi")
    cell = lambda c: F.floor(c / width)
    starts = own.select("_id", F.greatest(F.lit(0), F.col("start") - lead).alias("from")).distinct().withColumn("cell", F.explode(F.array(cell(F.col("from")), cell(F.col("from")) + 1)))
    inside = starts.join(own.withColumn("cell", cell(F.col("start"))), ["_id", "cell"]).where((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("from") + width))
    counted = inside.groupBy("_id", "from").agg(F.count_distinct("word").alias("words"))
    chosen = counted.groupBy("_id").agg(F.max_by(F.struct("from", "words"), F.struct("words", -F.col("from"))).alias("w")).join(rows, "_id")
    length, begin = F.length("_t"), F.col("w.from")
    end = F.least(length, begin + width)
    after = F.expr("locate(' ', _t, w.from + 1)") - 1
    moved = F.when((begin > 0) & (after >= 0) & (after < begin + slack), after + 1).otherwise(begin)
    tail = F.substring(F.col("_t"), end - slack + 2, F.lit(slack))
    last = end - slack + F.length(tail) + 1 - F.locate(" ", F.reverse(tail))
    shut = F.when((end < length) & F.contains(tail, F.lit(" ")), last).otherwise(end)
    told = chosen.select(F.col("_id.k").alias(key), F.col("_id.n").alias(number), moved.alias("start"), shut.alias("end"), F.col("w.words").alias("words"), "_t", length.alias("_n"))
    shown = F.concat(F.when(F.col("start") > 0, "…").otherwise(""), F.substring(F.col("_t"), F.col("start") + 1, F.col("end") - F.col("start")), F.when(F.col("end") < F.col("_n"), "…").otherwise(""))
    return told.select(key, number, "start", "end", "words", shown.alias("excerpt"))


def availability(wanted: DataFrame, known_versions: list[int], file_formats: tuple[str, ...] = ("plain", "json"), formats: tuple[str, ...] = ("classic", "plain", "json", "tls"), since: int = 19) -> DataFrame:
    """wanted (format, version, vm) with `available` (null where unknown) and status, in this order: an unknown format, an unknown version or VM, a file dump before `since`, available."""
    known = F.col("version").isin(known_versions) & (F.col("vm") == "hotspot")
    early = F.col("format").isin(*file_formats) & (F.col("version") < since)
    status = F.when(~F.col("format").isin(*formats), "unknown format").when(~known, "not established").when(early, "not available").otherwise("available")
    return wanted.withColumn("status", status).withColumn("available", F.when(F.col("status").isin("available", "not available"), F.col("status") == "available"))
