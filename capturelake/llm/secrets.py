"""Secret scans with DataFrame functions only: fixed patterns and character Markov models.

Patterns (leftmost, non-overlapping per kind): `assign` (a name, a sign and a value of 6+ characters), `access`
(AKIA..., 20+ characters) and `hex` (24+ characters). The method adds `markov` spans: whole runs of 20+ token
characters, or pieces of 20+ letters and digits of a run, not overlapping a pattern's span, whose log-likelihood ratio of
a bigram model of random strings to one of ordinary identifiers exceeds the threshold.

Both models are counted from labelled samples: random strings (hexadecimal and base-64 digests salted per document, label
1) and identifiers (label 0): words of the same documents and of Spark's settings in the forms of identifiers, paths,
addresses and settings, numbers and rulers. Every document is used. The threshold is fitted on
held-out ordinary samples. The models are one table of 96 x 96 log ratios, whatever the corpus. Positions are code points,
ends exclusive. Null and empty texts have no spans; repeated rows have equal ones. An id of random digits (a UUID) counts
as random.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import written

#: Fixed patterns of the base spans.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
PIECE = r"[A-Za-z0-9]{20,}"
#: Fixed words of the ordinary samples: roots and endings of paths.
ROOTS = ("src/main/java", "src", "usr/lib", "home/user", "var/log", "opt", "tmp", "etc", "org/example", "api/v1", "images", "static", "docs", "tests", "lib", "bin", "data", "assets")
ENDINGS = ("java", "py", "html", "txt", "json", "tar.gz", "md", "png", "xml", "csv", "js", "jpg", "pdf", "conf")
#: Of held-out ordinary runs this share may pass the threshold; random strings are taken to be this many times rarer.
FALSE_RATE = 0.0005
PRIOR = 10_000
#: Pairs of characters that an ordinary sample's chunks hold.
CHUNK = 2
MARK = "[SECRET]"
BLOCK = 1024
STEP = 128
_SPAN = "array<struct<start:int,rank:int,end:int>>"
_MATCH = "array<struct<start:int,rank:int,end:int,match:string>>"


def _let(value, use) -> F.Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(items, zero, step) -> F.Column:
    """The state after each item of an array, from `zero` by step(state, item).

    Spark copies an array to append to it, so blocks of STEP states are built apart and joined at the end.
    """

    def scan_of(xs):
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
        grow = lambda acc, x: _let(step(acc["at"], x), lambda new: F.struct(new.alias("at"), F.concat(acc["out"], F.array(new)).alias("out")))
        none = lambda state: F.struct(state.alias("at"), F.slice(F.array(state), F.lit(1), F.lit(0)).alias("out"))
        block = lambda acc, i: _let(F.aggregate(F.slice(xs, i, F.lit(STEP)), none(acc["at"]), grow), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        first = F.struct(zero.alias("at"), F.slice(F.array(F.array(zero)), F.lit(1), F.lit(0)).alias("out"))
        return F.flatten(F.aggregate(starts, first, block)["out"])

    return _let(items, scan_of)


def _spans(text, pattern: str, rank: int, value_length: int = 0) -> F.Column:
    """(start, rank, end, match) of a pattern's matches: lengths of the pieces between them add up to the positions."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if value_length else found
    pieces = F.arrays_zip(gaps.alias("gap"), found.alias("match"), values.alias("value"))

    def placed(ps):
        ends = _scan(F.transform(ps, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["match"]), F.lit(0))), F.lit(0), lambda at, n: at + n)
        spans = F.zip_with(ps, ends, lambda x, end: F.when(F.length(x["value"]) >= value_length, F.struct((end - F.length(x["match"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["match"].alias("match"))))
        return F.array_compact(spans)

    return F.when(text.rlike(pattern), _let(pieces, placed)).otherwise(F.array().cast(_MATCH))


def _apart(runs, base) -> F.Column:
    """The runs that overlap no base span: no earlier start reaches into them, no later one begins in them."""
    wide = F.lit(2**31 - 1)
    both = F.array_sort(F.concat(F.transform(base, lambda s: s.withField("match", F.lit(None).cast("string"))), runs))

    def kept(xs):
        is_base = lambda x: x["match"].isNull()
        before = _scan(xs, F.lit(0), lambda at, x: F.greatest(at, F.when(is_base(x), x["end"]).otherwise(F.lit(0))))
        after = F.reverse(_scan(F.reverse(xs), wide, lambda at, x: F.least(at, F.when(is_base(x), x["start"]).otherwise(wide))))
        near = F.zip_with(before, after, lambda a, b: F.struct(a.alias("reach"), b.alias("next")))
        return F.array_compact(F.zip_with(xs, near, lambda x, n: F.when(~is_base(x) & (n["reach"] <= x["start"]) & (n["next"] >= x["end"]), x)))

    return F.when(F.size(base) == 0, runs).when(F.size(runs) == 0, runs).otherwise(_let(both, kept))


def _bigrams(samples: DataFrame) -> DataFrame:
    """label, a, b (character codes less 32), n.

    Ordinary samples repeat the same words, so they are cut into chunks that share their end characters, and equal chunks
    are counted before they fall into pairs: a row for every CHUNK pairs. Chunks of random samples hardly repeat; theirs
    are single pairs. Samples are ASCII, so bytes are characters, and a place in them is found without reading up to it.
    """
    most = F.when(F.col("label") == 0, F.lit(CHUNK)).otherwise(F.lit(1))
    places = lambda column, step: F.explode(F.sequence(F.lit(1), F.length(column) - 1, step)).alias("at")
    placed = samples.where(F.length("sample") > 1).select("label", F.col("sample").cast("binary").alias("bytes"), places("sample", most))
    chunks = placed.select("label", F.substring("bytes", F.col("at"), most + 1).alias("chunk")).groupBy("label", "chunk").agg(F.count("*").alias("n"))
    pairs = chunks.select("label", "chunk", "n", places("chunk", F.lit(1))).select("label", F.substring("chunk", F.col("at"), F.lit(2)).alias("pair"), "n")
    code = lambda at: F.ascii(F.substring("pair", at, 1).cast("string")) - 32
    return pairs.groupBy("label", "pair").agg(F.sum("n").alias("n")).select("label", code(1).alias("a"), code(2).alias("b"), "n")


def _named(phrases: DataFrame) -> DataFrame:
    """source, sample: five words (source) written as one identifier, path, address or setting; the phrase's hash chooses the form.

    The words and their capitalized forms are columns of steps of their own, computed once a row; a form only joins them.
    As one expression the forms make a method above the 8,000 bytes that the JVM compiles.
    """
    pick = lambda choices, turn: F.element_at(F.array(*[F.lit(c) for c in choices]), (F.pmod(F.xxhash64("source", F.lit(turn)), F.lit(len(choices))) + 1).cast("int"))
    cut = phrases.select("source", F.split("source", "[^A-Za-z]+").alias("words"))
    low = cut.select("source", *[F.lower(F.col("words")[i]).alias(f"w{i}") for i in range(5)])
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    parts = low.select("*", *[capital(f"w{i}").alias(f"c{i}") for i in range(5)])
    w, c = [f"w{i}" for i in range(5)], [f"c{i}" for i in range(5)]
    ending, root, number = F.col("ending"), F.col("root"), F.col("number")
    joined = lambda sign, words=w: F.concat_ws(sign, *words)
    class_name, pascal = F.concat(*c[2:]), F.concat(*c)
    file = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("."), ending)
    forms = [
        joined("_"), joined("-"), F.upper(joined("_")), joined("."), joined(""), pascal, pascal, pascal, F.concat("w0", *c[1:]),
        F.concat_ws(".", root, "w0", "w1", class_name), file(root, "/", joined("/", w[:2]), "/", class_name),
        file("/", root, "/", joined("/", w[:2]), "/", joined("_", w[2:])), file("//www.", joined("-", w[:2]), ".com/", root, "/", joined("-", w[2:])),
        file(joined("_", w[:2]), "=/", root, "/", joined("_", w[2:]), "_v", number), file(joined("-", w[:3]), "-", F.substring(number, 1, 1), ".", number),
        F.concat(class_name, number, *c[:2]),
    ]
    numbered = F.pmod(F.xxhash64("source", F.lit(3)), F.lit(1000)).cast("string")
    picked = parts.select("*", pick(ENDINGS, 1).alias("ending"), pick(ROOTS, 2).alias("root"), numbered.alias("number"), F.pmod(F.xxhash64("source"), F.lit(len(forms))).alias("turn"))
    chosen = F.coalesce(*[F.when(F.col("turn") == i, form) for i, form in enumerate(forms)])
    return picked.select("source", F.explode(F.array(chosen)).alias("sample"))  # of a generated column no filter computes it again


def labelled_samples(docs: DataFrame, most: int | None = None) -> DataFrame:
    """label, sample, held_out: random strings (1), and identifiers, numbers and rulers (0).

    The words are those of every document or, where `most` is given, of so many in hash order (of rows with one id the
    smallest text), and of Spark's own settings and their descriptions, which bring names of real code whatever the corpus. One phrase or document in five is held out, by hash.
    """
    spark = docs.sparkSession
    some = docs.where("text <> ''")
    if most is not None:
        filled = some.where("doc_id IS NOT NULL")
        ids = filled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = filled.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    settings = spark.sql("SET -v").select(F.col("key").alias("name"), F.concat_ws(" ", "key", "meaning").alias("text"))
    texts = some.select(F.coalesce(F.col("doc_id").cast("string"), F.md5("text")).alias("name"), F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ").alias("text")).unionByName(settings)
    numbers = F.concat(*[F.lpad(F.pmod(F.xxhash64("name", F.lit(i)), F.lit(10**9)).cast("string"), 9, "0") for i in range(4)])
    hashed = texts.select("name", F.sha2(F.concat_ws(":", F.lit("sample"), F.col("name")), 512).alias("digest"), numbers.alias("digits"))
    coded = hashed.select("*", F.regexp_replace(F.base64(F.unhex("digest")), r"\s", "").alias("base64"))  # base64 breaks lines
    names = coded.select("*", F.regexp_replace("base64", "[^A-Za-z0-9]", "").alias("letters"))
    sign = lambda turn: F.element_at(F.array(*[F.lit(c) for c in "-=_.+/"]), (F.pmod(F.xxhash64("name", F.lit(turn)), F.lit(6)) + 1).cast("int"))
    random = [F.substring("digest", 1, 40), F.upper(F.substring("digest", 41, 40)), F.substring("base64", 1, 40), F.translate(F.substring("base64", 41, 44), "+/", "-_"), F.substring("letters", 1, 32), F.upper(F.substring("letters", 41, 24))]
    part = lambda at, n: F.substring("digits", at, n)
    plain = [F.col("digits"), F.concat_ws("-", part(1, 4), part(5, 2), F.concat(part(7, 2), F.lit("T"), part(9, 2)), part(11, 2), part(13, 2)), F.concat_ws(".", part(1, 3), part(4, 2), part(6, 3), part(9, 2), part(11, 3), part(14, 4)), F.concat_ws("/", part(1, 4), part(5, 2), part(7, 2), part(9, 6), part(15, 6)), F.repeat(sign(4), F.lit(40)), F.repeat(F.concat(sign(5), sign(6)), F.lit(20))]
    phrase = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}(?:[^A-Za-z]+[A-Za-z]{2,}){4}"), F.lit(0)))
    ordinary = _named(texts.select(phrase.alias("source"))).select("source", F.lit(0).alias("label"), "sample")
    labelled = lambda label, made: [F.struct(F.lit(label).alias("label"), x.alias("sample")) for x in made]
    both = names.select(F.col("name").alias("source"), F.inline(F.array(*labelled(1, random), *labelled(0, plain)))).unionByName(ordinary)
    return both.select("label", "sample", (F.pmod(F.xxhash64("source"), F.lit(5)) == 0).alias("held_out"))


def log_ratios(samples: DataFrame) -> list[float]:
    """The 96 x 96 table ln P(b | a, random) - ln P(b | a, ordinary), add-half smoothed over 68 characters."""
    n = {(r.label, r.a, r.b): r.n for r in _bigrams(samples).collect()}  # at most 2 * 96 * 96 rows
    row = {(k, a): sum(n.get((k, a, b), 0) for b in range(96)) for k in (0, 1) for a in range(96)}
    p = lambda k, a, b: (n.get((k, a, b), 0) + 0.5) / (row[k, a] + 34)
    return [math.log(p(1, a, b) / p(0, a, b)) for a in range(96) for b in range(96)]


def fitted(docs: DataFrame) -> tuple[list[float], float]:
    """The table of log ratios and the threshold: the lowest held-out ordinary run that no more than FALSE_RATE of them pass, ln PRIOR at least.

    Samples are made as they are counted and never stored; of held-out runs the ratio is, and only those of one unit of
    ratio are ordered to find the threshold.
    """
    samples = labelled_samples(docs)
    table = log_ratios(samples.where("NOT held_out"))
    runs = samples.where("held_out AND label = 0").where(F.length("sample") >= 20)
    scored = written(runs.select(_ratio(F.col("sample"), _table(table)).alias("ratio")))
    unit = F.floor("ratio")
    counts = sorted(((r.unit, r.n) for r in scored.groupBy(unit.alias("unit")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a row for each unit
    passing = int(sum(n for _, n in counts) * FALSE_RATE)
    for at, n in counts:
        if n > passing:
            top = scored.where(unit == at).orderBy(F.desc("ratio")).limit(passing + 1).agg(F.min("ratio").alias("top")).first().top
            return table, max(math.log(PRIOR), top)
        passing -= n
    return table, math.log(PRIOR)


def _table(ratios: list[float]) -> F.Column:
    """The ratios as one literal, read from a string: thousands of literals would make a large plan."""
    return F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")


def _ratio(run, table) -> F.Column:
    at = lambda x, y: F.element_at(table, (x - 32) * 96 + y - 31)
    codes = F.transform(F.split(run, ""), F.ascii)
    steps = _let(codes, lambda xs: F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs) - 1), at))
    return F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)


def _judged(run, table, threshold: float) -> F.Column:
    """The run if it is random as a whole, else those of its pieces of 20 or more letters and digits that are."""
    pieces = F.filter(_spans(run["match"], PIECE, 3), lambda x: _ratio(x["match"], table) > threshold)
    placed = F.transform(pieces, lambda x: F.struct((x["start"] + run["start"]).alias("start"), x["rank"].alias("rank"), (x["end"] + run["start"]).alias("end"), x["match"].alias("match")))
    return F.when(_ratio(run["match"], table) > threshold, F.array(run)).when(run["match"].rlike("[+/_=.-]"), placed).otherwise(F.array().cast(_MATCH))


def find_secrets(docs: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with base_spans and all_spans: start, rank (place in KINDS), end.

    Columns of these two names are replaced. Work grows linearly with a text's length and number of matches. A threshold
    takes the place of the fitted one.
    """
    ratios, limit = fitted(docs.select("doc_id", "text"))
    limit = limit if threshold is None else threshold
    table = _table(ratios)
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    runs = F.flatten(F.transform(_spans(text, RUN, 3), lambda r: _judged(r, table, limit)))
    found = _let(base, lambda b: F.struct(b.alias("base"), _apart(runs, b).alias("more")))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    with_found = docs.withColumn("all_spans", found)
    return with_found.withColumn("base_spans", plain(F.col("all_spans.base"))).withColumn("all_spans", F.array_sort(F.concat(plain(F.col("all_spans.base")), plain(F.col("all_spans.more")))))


def _written(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = lambda rank: F.size(F.filter("base_spans", lambda s: s["rank"] == rank)).cast("long")
    return find_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents, columns unchanged whatever their names, with every span replaced by a mark (overlapping spans by one) and n_chars renewed."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_secrets(whole)
    reach = _scan(F.col("all_spans"), F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(x):
        def piece(a, b):  # characters a up to b, from the blocks that hold them
            first = F.floor(a / BLOCK).cast("int")
            last = F.floor((b - 1) / BLOCK).cast("int")
            return F.when(b > a, F.substring(F.array_join(F.slice(x["blocks"], first + 1, last - first + 1), ""), a - first * BLOCK + 1, b - a)).otherwise("")

        before = F.concat(F.array(F.lit(0)), x["reach"])
        kept = F.zip_with(x["spans"], F.slice(before, F.lit(1), F.size(x["spans"])), lambda s, at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit(MARK))))
        return F.concat(F.array_join(F.array_compact(kept), ""), piece(F.element_at(before, -1), x["length"]))

    parts = F.struct(F.col("all_spans").alias("spans"), reach.alias("reach"), blocks.alias("blocks"), F.length("text").alias("length"))
    hit = F.size("all_spans") > 0
    new = found.select("row", hit.alias("hit"), F.when(hit, _let(parts, cut)).otherwise(F.col("text")).alias("text"))
    value = {"text": F.col("text").cast(documents.schema["text"].dataType)}
    if "n_chars" in documents.columns:
        value["n_chars"] = F.when(F.col("hit"), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return new.select(*[value.get(c, F.col("row").getField(c)).alias(c) for c in documents.columns])
