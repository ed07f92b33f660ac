"""Similar stacks: scores of frame lists, candidate pairs by shared frames, leader clusters over a session and their summary.

Scores are taken once for each pair of distinct shapes (lists of frames) that share a frame, not for pairs of threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators.generic import cut

#: Weights of the parts in each way to compare.
MIXES = {
    "common-tail": {"tail": 0.55, "run": 0.25, "ordered": 0.10, "overlap": 0.10},
    "shifted-subsequence": {"run": 0.55, "ordered": 0.20, "overlap": 0.15, "app": 0.10},
    "near-sequence": {"ordered": 0.50, "run": 0.20, "prefix": 0.10, "app": 0.10, "overlap": 0.10},
    "frame-overlap": {"overlap": 0.60, "app": 0.20, "ordered": 0.10, "run": 0.10},
}
#: Least score to join a cluster, least score of a common tail alone, quality labels.
JOINS, TAIL_JOINS = 0.42, 0.72
QUALITIES = ((0.90, "Exact-ish"), (0.78, "Strong"))


def _longer(a, b):
    return F.greatest(F.size(a), F.size(b), F.lit(1))


def _common_start(a, b):
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same))


def _in_order(a, b):
    """Frames of a that are met one after the other in b."""
    def step(s, x):
        at = F.array_position(F.slice(b, s["at"] + 1, F.size(b)), x)
        return F.struct(F.when(at > 0, s["at"] + at).otherwise(F.size(b)).cast("int").alias("at"), (s["n"] + (at > 0).cast("int")).alias("n"))

    return F.aggregate(a, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step)["n"]


def _longest_run(a, b):
    def step(s, x):
        above = F.concat(F.array(F.lit(0)), s["row"])
        row = F.zip_with(b, F.slice(above, F.lit(1), F.size(b)), lambda y, n: F.when(y == x, n + 1).otherwise(0))
        return F.struct(row.alias("row"), F.greatest(s["best"], F.coalesce(F.array_max(row), F.lit(0))).alias("best"))

    return F.aggregate(a, F.struct(F.transform(b, lambda y: F.lit(0)).alias("row"), F.lit(0).alias("best")), step)["best"]


def _overlap(a, b):
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def similarity(pairs: DataFrame) -> DataFrame:
    """pairs (a, b: meaningful frames, app_a, app_b: of the application) with score (0 to 1) and method.

    Equal lists score 1. Else the best of MIXES; a common tail of under two frames gives way to a run of four or more, and
    an overlap of under two frames is a `variant-merge` of at most 0.55.
    """
    head = lambda c, n=12: F.slice(c, F.lit(1), F.lit(n))
    back = lambda c: F.slice(F.reverse(c), F.lit(1), F.lit(12))
    rows = pairs.select("*", head("a").alias("ha"), head("b").alias("hb"), back(F.col("a")).alias("ta"), back(F.col("b")).alias("tb"))
    rows = rows.withColumn("run_length", _longest_run(F.col("ha"), F.col("hb"))).withColumn("tail_length", _common_start(F.col("ta"), F.col("tb")))
    part = {
        "prefix": _common_start(head("a", 6), head("b", 6)) / _longer(head("a", 6), head("b", 6)), "tail": F.col("tail_length") / _longer(F.col("ta"), F.col("tb")),
        "ordered": _in_order(F.col("ha"), F.col("hb")) / _longer(F.col("ha"), F.col("hb")), "overlap": _overlap(F.col("ha"), F.col("hb")), "app": _overlap(head("app_a", 8), head("app_b", 8)),
        "run": F.col("run_length") / _longer(F.col("ha"), F.col("hb")),
    }
    rows = rows.withColumns({f"part_{k}": v for k, v in part.items()})
    mixed = {name: sum((F.col(f"part_{k}") * w for k, w in weights.items()), F.lit(0.0)) for name, weights in MIXES.items()}
    order = list(MIXES)
    best = F.greatest(*[F.struct(score.alias("score"), F.lit(len(order) - i).alias("first"), F.lit(name).alias("method")) for i, (name, score) in enumerate(mixed.items())])
    rows = rows.withColumn("best", best).withColumn("shifted", mixed["shifted-subsequence"]).withColumn("shared", F.size(F.array_intersect("ha", "hb")))
    moved = (F.col("best.method") == "common-tail") & (F.col("tail_length") < 2) & (F.col("run_length") >= 4)
    merged = (F.col("best.method") == "frame-overlap") & (F.col("shared") < 2)
    exact = (F.size("a") > 0) & (F.col("a") == F.col("b"))
    method = F.when(exact, "normalized-exact").when(moved, "shifted-subsequence").when(merged, "variant-merge").otherwise(F.col("best.method"))
    score = F.when(exact, 1.0).when(moved, F.col("shifted")).when(merged, F.least(F.col("best.score"), F.lit(0.55))).otherwise(F.col("best.score"))
    return rows.select(*pairs.columns, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"), method.alias("method"), "tail_length", "run_length")


def shapes(fingerprinted: DataFrame) -> DataFrame:
    """Distinct (session, shape, frames, app) of threads with meaningful frames; shape: a hash of the frames."""
    return fingerprinted.where(F.size("meaningful_frames") > 0).select("session", F.sha2(F.to_json("meaningful_frames"), 256).alias("shape"), F.col("meaningful_frames").alias("frames"), F.col("app_frames").alias("app")).dropDuplicates(["session", "shape"])


def candidates(of_shapes: DataFrame) -> DataFrame:
    """Pairs of shapes of a session that share one of their first eight or last sixteen frames, with both frame lists; each shape pairs with itself.

    A pair goes on if the first eight frames overlap or the last sixteen share an end of ten: the rest cannot join a cluster.
    """
    keyed = of_shapes.select("session", "shape", F.explode(F.array_distinct(F.concat(F.slice("frames", 1, 8), F.slice(F.reverse("frames"), 1, 16)))).alias("frame"))
    met = keyed.alias("x").join(keyed.alias("y"), (F.col("x.session") == F.col("y.session")) & (F.col("x.frame") == F.col("y.frame"))).select(F.col("x.session").alias("session"), F.col("x.shape").alias("shape"), F.col("y.shape").alias("leader")).distinct()
    a = of_shapes.select("session", "shape", F.col("frames").alias("a"), F.col("app").alias("app_a"))
    b = of_shapes.select("session", F.col("shape").alias("leader"), F.col("frames").alias("b"), F.col("app").alias("app_b"))
    top = F.arrays_overlap(F.slice("a", 1, 8), F.slice("b", 1, 8))
    tail = _common_start(F.slice(F.reverse("a"), 1, 16), F.slice(F.reverse("b"), 1, 16)) >= 10
    return met.join(a, ["session", "shape"]).join(b, ["session", "leader"]).where(top | tail)


def leader_clusters(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """rows (session, shape, place) with leader_place, score and method of the cluster they join, in order of place.

    A row looks at the earlier leader with the best score (ties: the earliest): it joins if that is JOINS or more and no
    common tail below TAIL_JOINS (a weak tie), else it leads. A shape leads once at most, as its later rows join it; so
    the rounds are about shapes, each with its first undecided row. In all sessions at once
    - a shape never leads if it can join a leader before that row, and no undecided shape has a better, weak tie to it;
    - it leads if it cannot join, and no undecided neighbour has an earlier row;
    - it goes on to the next row that anything could change, if it joins for now but a weak tie is still undecided.
    The earliest undecided row of a session always falls under one of these; rounds follow the longest chain of first rows
    that wait for each other, not the number of leaders.
    """
    key = ["session", "shape"]
    rows = cut(rows.select(*key, "place"))
    weak = (F.col("method") == "common-tail") & (F.col("score") < TAIL_JOINS)
    links = cut(scored.where(F.col("score") >= JOINS).select(*key, F.col("leader").alias("other"), "score", "method", weak.alias("weak")))
    open_ = cut(rows.groupBy(*key).agg(F.min("place").alias("next")))
    leads = cut(open_.limit(0).select(*key, F.col("next").alias("leader_place")))
    as_other = {"shape": "other"}
    while True:
        offers = open_.join(links, key).join(leads.withColumnsRenamed(as_other), ["session", "other"])
        before = F.col("leader_place") < F.col("next")
        at = F.struct("score", (-F.col("leader_place")).alias("first"), "weak")
        best = offers.groupBy(*key).agg(F.max(F.when(before, at)).alias("best"), F.min(F.when(~before, F.col("leader_place"))).alias("change"))
        beside = open_.select(*key).join(links, key).where("shape <> other").join(open_.withColumnsRenamed(as_other | {"next": "other_next"}), ["session", "other"])
        wait = beside.groupBy(*key).agg(F.min("other_next").alias("wait"), F.max(F.when(F.col("weak"), F.col("score"))).alias("doubt"))
        state = open_.join(best, key, "left").join(wait, key, "left")
        joins = F.coalesce(~F.col("best.weak"), F.lit(False))
        free = F.coalesce(F.col("wait") > F.col("next"), F.lit(True))
        verdict = F.when(joins & F.coalesce(F.col("doubt") < F.col("best.score"), F.lit(True)), "never").when(~joins & free, "leads").when(joins & free, "later").otherwise("waits")
        state = cut(state.select(*key, "next", verdict.alias("verdict"), F.least("wait", "change").alias("until")))
        new = state.where("verdict = 'leads'").select(*key, F.col("next").alias("leader_place"))
        later = rows.join(state.where("verdict = 'later' AND until IS NOT NULL"), key).where("place >= until").groupBy(*key).agg(F.min("place").alias("next"))
        leads = cut(leads.unionByName(new))
        open_ = cut(state.where("verdict = 'waits'").select(*key, "next").unionByName(later))
        if not open_.take(1):
            break
    met = links.join(leads.withColumnsRenamed(as_other), ["session", "other"]).withColumn("at", F.struct("score", (-F.col("leader_place")).alias("first"), "method"))
    order = Window.partitionBy(*key).orderBy("leader_place")
    steps = met.select(*key, F.max("at").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("best"), F.col("leader_place").alias("after"), F.lead("leader_place").over(order).alias("upto"))
    found = rows.join(leads, key, "left").join(steps, key, "left").where("after IS NULL OR (place > after AND place <= coalesce(upto, place)) OR place = leader_place")
    own = F.coalesce(F.col("place") == F.col("leader_place"), F.lit(False))
    return found.select(
        *key, "place", F.when(own, F.col("place")).otherwise(-F.col("best.first")).alias("leader_place"), F.when(own, 1.0).otherwise(F.col("best.score")).alias("score"), F.when(own, "normalized-exact").otherwise(F.col("best.method")).alias("method")
    ).dropDuplicates(["session", "place"])


def cluster_summary(members: DataFrame) -> DataFrame:
    """Clusters (rows session, leader_place, snapshot, score, method) seen in two snapshots at least: members, snapshots, longest run of them, mean score, its label and the main method; ranked by snapshots, run, members."""
    key = ["session", "leader_place"]
    seen = members.select(*key, "snapshot").distinct().withColumn("island", F.col("snapshot") - F.row_number().over(Window.partitionBy(*key).orderBy("snapshot")))
    runs = seen.groupBy(*key, "island").agg(F.count("*").alias("n")).groupBy(*key).agg(F.sum("n").alias("snapshots"), F.max("n").alias("longest_run"))
    methods = members.groupBy(*key, "method").agg(F.count("*").alias("n")).groupBy(*key).agg(F.max_by("method", F.struct("n", "method")).alias("main_method"))
    per = members.groupBy(*key).agg(F.count("*").alias("members"), F.avg("score").alias("mean_score"))
    label = F.lit("Loose")
    for least, name in reversed(QUALITIES):
        label = F.when(F.col("mean_score") >= least, name).otherwise(label)
    out = per.join(runs, key).join(methods, key).where("snapshots >= 2").withColumn("quality", label)
    order = Window.partitionBy("session").orderBy(F.desc("snapshots"), F.desc("longest_run"), F.desc("members"), "leader_place")
    return out.withColumn("rank", F.row_number().over(order))
