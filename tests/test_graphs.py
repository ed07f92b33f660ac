"""Counts of ancestors against a plain search on random graphs, trees and cycles."""

import random

from capturelake.operators import generic


def searched(edges):
    above = {}
    for a, b in edges:
        above.setdefault(b, set()).add(a)
        above.setdefault(a, set())
    out = {}
    for node in above:
        seen, todo = set(), [node]
        while todo:
            for x in above[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out[node] = len(seen - {node})
    return out


def test_ancestors_of_random_graphs(spark):
    rng = random.Random(5)
    edges = set()
    for g in range(4):  # graphs of their own: few and many forks, cycles, self loops
        n = 14
        for i in range(n):
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3] if g % 2 else [1, 1, 1, 1, 0])):
                edges.add((100 * g + i, 100 * g + rng.randrange(n)))
    got = {r.node: r.n for r in generic.ancestor_counts(spark.createDataFrame(sorted(edges), "source int, target int")).collect()}
    assert got == searched(edges) and max(got.values()) > 8


def test_rows_stay_linear_on_a_tree(spark, monkeypatch):
    most = []
    monkeypatch.setattr(generic, "cut", lambda df, cut=generic.cut: (lambda out: most.append(out.count()) or out)(cut(df)))
    edges = [(i, i // 3) for i in range(1, 3_000)]
    got = {r.node: r.n for r in generic.ancestor_counts(spark.createDataFrame(edges, "source int, target int")).collect()}
    assert got == searched(edges) and max(most) <= 3_000


def test_own_counts_nodes_of_cycles_and_loops(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (5, 6), (7, 6)]
    got = {r.node: r.n for r in generic.ancestor_counts(spark.createDataFrame(edges, "source int, target int"), own=True).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 3, 5: 1, 6: 2, 7: 0}
    pairs = generic.reach(spark.createDataFrame(edges, "source int, target int")).groupBy("target").count().collect()
    assert {r.target: r["count"] for r in pairs} == {k: v for k, v in got.items() if v}


def test_reach_reads_its_edges_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(generic, "cut", lambda df, cut=generic.cut: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    assert generic.reach(spark.range(6).selectExpr("id AS source", "id + 1 AS target")).count() == 21
    assert len(plans) > 5 and sum("Range (" in p for p in plans) == 1
