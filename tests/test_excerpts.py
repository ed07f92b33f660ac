"""Excerpts of sections against a plain search."""

import random
import re

from capturelake.operators import generic


def plain(sections, query, width=240, lead=65, slack=25):
    wanted = generic.query_words(query)
    best = None
    for number, text in sections:
        hits = []
        for word in re.finditer(r"\w+", text):
            for w in wanted:
                if not w.isdigit() or word[0].lower() == w:
                    hits += [(word.start() + m.start(), -(word.start() + m.end()), w) for m in re.finditer(re.escape(w), word[0], re.IGNORECASE)]
        merged = []
        for a, b, w in sorted(hits):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], -b)
            else:
                merged.append([a, -b, w])
        found = len({w for *_, w in merged})
        if merged and (best is None or found > best[0]):
            best = (found, number, text, merged)
    if best is None:
        return None
    _, number, text, merged = best
    count = lambda s: len({w for a, b, w in merged if a >= s and b <= s + width})
    start = min({max(0, a - lead) for a, *_ in merged}, key=lambda s: (-count(s), s))
    words, end = count(start), min(len(text), start + width)
    if start > 0 and 0 <= (space := text.find(" ", start)) < start + slack:
        start = space + 1
    if end < len(text) and (space := text.rfind(" ", 0, end + 1)) > end - slack:
        end = space
    return number, start, end, words, f"{'…' * (start > 0)}{text[start:end]}{'…' * (end < len(text))}"


def test_excerpts_of_sections(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "alphabet", "4", "44", "x" * 40, "delta", "é́", "a", "be"]
    docs = {k: [(n, " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(rng.choice([0, 3, 60, 150])))) for n in range(rng.randrange(1, 5))] for k in range(60)}
    docs[70], docs[71] = [(0, None), (1, "alpha")], [(0, "nothing")]
    rows = [(k, n, t) for k, sections in docs.items() for n, t in sections]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, n int, t string")
    for query in ("alpha beta 4 phab", "delta missing", "none"):
        got = {r.k: (r.n, r.start, r.end, r.words, r.excerpt) for r in generic.section_excerpts(df, "k", "n", "t", query).collect()}
        want = {k: plain([(n, t or "") for n, t in sections], query) for k, sections in docs.items()}
        assert got == {k: v for k, v in want.items() if v}
