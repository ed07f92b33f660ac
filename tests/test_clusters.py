"""Leader clusters against a sequential pass over made score tables."""

import random

from capturelake.operators import clusters


def in_sequence(rows, scores):
    leaders, out = {}, {}
    for session, shape, place in sorted(rows, key=lambda r: r[2]):
        options = [(scores[session, shape, s][0], -p, scores[session, shape, s][1]) for (x, s), p in leaders.items() if x == session and (session, shape, s) in scores]
        best = max(options, default=None)
        if best is None or best[0] < clusters.JOINS or best[2] == "common-tail" and best[0] < clusters.TAIL_JOINS:
            leaders[session, shape] = place
            out[session, place] = (place, 1.0, "normalized-exact")
        else:
            out[session, place] = (-best[1], best[0], best[2])
    return out, leaders


def made(rng, sessions, shapes, n, density, weak):
    rows, scores = [], {}
    for session in sessions:
        for i in range(shapes):
            scores[session, f"s{i}", f"s{i}"] = (1.0, "normalized-exact")
            for j in range(i):
                if rng.random() < density:
                    pair = (round(rng.uniform(0.3, 0.99), 2), "common-tail" if rng.random() < weak else "near-sequence")
                    scores[session, f"s{i}", f"s{j}"] = scores[session, f"s{j}", f"s{i}"] = pair
        places = rng.sample(range(10 * n), n)
        rows += [(session, f"s{int(shapes * rng.random() ** 2)}", p) for p in places]
    return rows, scores


def compare(spark, rows, scores):
    scored = spark.createDataFrame([(x, a, b, s, m) for (x, a, b), (s, m) in scores.items()], "session string, shape string, leader string, score double, method string")
    got = clusters.leader_clusters(spark.createDataFrame(rows, "session string, shape string, place int"), scored).collect()
    want, leaders = in_sequence(rows, scores)
    assert len(got) == len(want)
    assert {(r.session, r.place): (r.leader_place, r.score, r.method) for r in got} == want
    return leaders


def test_leaders_of_two_thousand_stacks(spark):
    rng = random.Random(3)
    rows, scores = made(rng, ["a", "b"], 60, 1_000, 0.15, 0.5)
    assert len(compare(spark, rows, scores)) > 20


def test_leaders_without_ties_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(clusters, "cut", lambda df, cut=clusters.cut: rounds.append(1) or cut(df))
    rows = [("a", f"s{i}", i) for i in range(3_000)] + [("a", f"s{i}", 5_000 + i) for i in range(3_000)]
    scores = {("a", f"s{i}", f"s{i}"): (1.0, "normalized-exact") for i in range(3_000)}
    assert len(compare(spark, rows, scores)) == 3_000 and len(rounds) < 12


def test_a_weak_tie_makes_a_later_row_lead(spark):
    pair = lambda a, b, s, m: {("a", a, b): (s, m), ("a", b, a): (s, m)}
    scores = {("a", x, x): (1.0, "normalized-exact") for x in "xyz"} | pair("x", "y", 0.5, "near-sequence") | pair("x", "z", 0.6, "common-tail")
    rows = [("a", "y", 1), ("a", "x", 2), ("a", "x", 3), ("a", "z", 4), ("a", "x", 5), ("a", "x", 6)]
    assert compare(spark, rows, scores) == {("a", "y"): 1, ("a", "z"): 4, ("a", "x"): 5}
