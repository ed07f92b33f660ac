"""N-gram Jaccard join: every document's component under links of word n-gram sets.

Sets are put in one global order, rare n-grams first. Two sets that link share an n-gram within a short prefix of that
order, so prefixes give the candidates. Candidates of one query set are stored as a trie of ordered sets; a traversal
shares the overlap counted along a common prefix and leaves a subtree when what remains cannot reach the bound.

Only what decides components is compared. Each prefix n-gram and length class has one hub, the set whose prefix others
share most. First each set meets the hub with which it shares most prefix n-grams, unless the first bound below rules out
that they link, and its whole overlap with that hub is kept; then
every candidate pair between different components is compared, whatever its number, so no link between different
components is missed. Two bounds, both exact, tell which pairs are candidates; at a shared n-gram of both prefixes

- prefix n-grams that stand before it and are in no other prefix cannot be common, nor can more follow than remain;
- of a hub that both have met, the n-grams which either lacks are not common. They are counted in 16 buckets, and the
  larger of both counts is lacking in at least one; besides these, only n-grams outside the hub can be common.

So a large group of near copies, of which most link through their hub, leaves hardly any pair to compare.

Exact copies are one set throughout. Frequencies for the order are counted over all sets in a table of 2**SKETCH_BITS
cells; any order gives the same result. An n-gram in more than `hot` sets is dealt to several tasks. N-grams and sets
are compared by 64-bit hashes. Null, empty and blank texts have an empty set and link with nothing. A component is named
by its smallest doc_id; rows without a doc_id link others, and have a null component_id where all of it lacks one.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.llm.common import base_columns, cut_lineage, mix64, row_blocks, shingles, utf8_buffers, words, written
from capturelake.llm.components import components

SKETCH_BITS = 21
_BLOCK = 4096
_SHARD = 512
#: Up to this many pairs of 8-byte keys are broadcast (they are counted first); beyond that the join is shuffled.
BROADCAST_IDS = 500_000
#: Rows of one n-gram that a task takes.
HOT = 1 << 20
BUCKETS = 16


def _sets(batches, width: int):
    """(rows, list of ascending distinct 64-bit n-gram hashes, one per row) for blocks of rows."""
    for batch in batches:
        flat, offsets = utf8_buffers(batch.column("text"))
        for a, b in row_blocks(offsets):
            h, _, first = words(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield batch.slice(a, b - a), [np.unique(shingles(h, first, i, width)) for i in range(b - a)]


def _set_id(grams: np.ndarray) -> int:
    """One 64-bit key for a whole set."""
    with np.errstate(over="ignore"):
        x = mix64(np.array([len(grams)], np.uint64) + mix64(grams).sum(dtype=np.uint64) * np.uint64(3) + np.bitwise_xor.reduce(mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
    return int(x.view(np.int64)[0])


def _need(n: int, m: int, percent: int) -> int:
    """Smallest shared count with 100 * shared >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _first_pass(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, key, n_shingles, set_id) of every row, and how many sets hold an n-gram of each cell: a fixed number of counters."""

    def run(batches):
        cells = np.zeros(1 << SKETCH_BITS, np.uint32)
        for rows, sets in _sets(batches, width):
            for s in sets:
                np.add.at(cells, _cell(s), np.uint32(1))
            none = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(len(sets), pa.int32()), none], names)
        blocks = [i for i in range(0, len(cells), _BLOCK) if cells[i : i + _BLOCK].any()]
        counts = pa.array([zlib.compress(cells[i : i + _BLOCK].tobytes(), 1) for i in blocks], pa.binary())
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i // _BLOCK for i in blocks], pa.int32()), counts], names)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes(), 1) for v in sums.values()], pa.binary())], ["block", "counts"])

    names = ["doc_id", "key", "n_shingles", "set_id", "block", "counts"]
    both = cut_lineage(docs.mapInArrow(run, "doc_id long, key long, n_shingles long, set_id long, block int, counts binary"))
    summed = both.where("block is not null").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in summed.toLocalIterator():  # 2**SKETCH_BITS counters in all
        out[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(zlib.decompress(bytes(row.counts)), np.uint32)
    return both.where("block is null").drop("block", "counts"), out


def _shared_only(rows: DataFrame, hot: int) -> DataFrame:
    """Of rows (deal, token, id, n, place, cell), one of each token and id, those whose token more than one id has; streamed in token order.

    Tokens of more than `hot` sets, by the cell's count, are in several deals and stay whole.
    """

    names = ["token", "id", "n", "place", "cell"]

    def run(batches):
        held, met = None, False  # the last row waits for its successor; met: its predecessor has its token
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            same = columns[0][1:] == columns[0][:-1]
            new = np.concatenate([[True], ~(same & (columns[1][1:] == columns[1][:-1]))])
            columns = [c[new] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            before = np.concatenate([[met], same])
            keep = before | np.concatenate([same, [False]]) | (columns[4] > hot)
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)
            held, met = [c[-1:] for c in columns], bool(before[-1])
        if held is not None and (met or held[4][0] > hot):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names)

    return rows.repartition("deal").select(names).sortWithinPartitions("token", "id").mapInArrow(run, "token long, id long, n int, place int, cell long")


def _ordered(grams: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, cells[_cell(grams)]))]


class SetTrie:
    """Ordered sets as an implicit trie: rows in lexicographic order, each sharing a known prefix with the row before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.rank = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.rank]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def walk(self, query: np.ndarray, percent: int, whole: bool = False, step: int = 64):
        """(place in the given list, overlap, places in the ascending query of what is common) of the sets that link with the query; `whole`: of all sets."""
        probe = np.sort(query)
        counts = np.zeros(1, np.int64)  # overlap after each element of the row before, as far as it was walked
        common = np.zeros(0, np.int64)
        for at, (row, shared) in enumerate(zip(self.sets, self.shared, strict=True)):
            depth = min(shared, len(counts) - 1)
            counts = counts[: depth + 1]
            have = int(counts[-1])
            parts, places = [counts], [common[:have]]
            need = 0 if whole else _need(len(query), len(row), percent)
            if min(len(query), len(row)) >= need:
                while depth < len(row) and have + min(len(row) - depth, len(query) - have) >= need:
                    part = row[depth : depth + step]
                    found = np.searchsorted(probe, part)
                    found[found == len(probe)] = 0
                    hit = probe[found] == part
                    run = have + np.cumsum(hit)
                    parts.append(run)
                    places.append(found[hit])
                    have, depth = int(run[-1]), depth + len(part)
            counts, common = np.concatenate(parts), np.concatenate(places)
            if depth == len(row) and have >= need:
                yield self.rank[at], have, common


def _lacking(query: np.ndarray, common: np.ndarray) -> tuple[int, int]:
    """How many of the ascending query's elements are not common, by bucket: 16 counts up to 255 in two longs."""
    bucket = (query & np.uint64(BUCKETS - 1)).astype(np.int64)
    lack = np.bincount(bucket, minlength=BUCKETS) - np.bincount(bucket[common], minlength=BUCKETS)
    low, high = np.minimum(lack, 255).astype(np.uint8).view(np.int64)
    return int(low), int(high)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, small: bool, whole: bool) -> DataFrame:
    """Candidate pairs (a, b) with both sizes, the overlap and what of a is lacking in b; those that link or, if `whole`, all.

    A query's candidates go to tries of bounded size on many tasks.
    """
    shards = pairs.groupBy("a").agg(F.ceil(F.count("*") / _SHARD).alias("shards"))
    dealt = pairs.join(shards, "a").select("a", "b", F.pmod(F.xxhash64("b"), "shards").alias("shard"))
    heads = dealt.select("a", "shard").distinct().select(F.col("a").alias("id"), "a", "shard", F.lit(0).alias("kind"))
    roles = cut_lineage(heads.unionByName(dealt.select(F.col("b").alias("id"), "a", "shard", F.lit(1).alias("kind"))))
    rows = sets.join(F.broadcast(roles) if small else roles, "id").repartition("a", "shard").sortWithinPartitions("a", "shard", "kind")
    kinds = {"a": pa.int64(), "b": pa.int64(), "size": pa.int32(), "other": pa.int32(), "common": pa.int32(), "low": pa.int64(), "high": pa.int64()}

    def run(batches):
        key = query = None
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def flush():
            found = []
            if ids and query is not None:
                ascending = np.sort(query)
                found = [(key[0], ids[i], len(query), len(sets[i]), n, *(_lacking(ascending, at) if whole else (0, 0))) for i, n, at in SetTrie(sets).walk(query, percent, whole)]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            for a, shard, kind, i, grams in zip(*(batch.column(c).to_pylist() for c in ("a", "shard", "kind", "id", "grams")), strict=True):
                if (a, shard) != key or len(ids) >= _SHARD:
                    yield flush()
                    ids, sets = [], []
                    if (a, shard) != key:
                        key, query = (a, shard), None
                if kind == 0:
                    query = np.frombuffer(grams, np.uint64)
                else:
                    ids.append(i)
                    sets.append(np.frombuffer(grams, np.uint64))
        yield flush()

    return rows.mapInArrow(run, "a long, b long, size int, other int, common int, low long, high long")


def _need_of(x, y, percent: int) -> F.Column:
    return F.ceil((x + y) * F.lit(percent) / F.lit(100 + percent))


def _room(n, place, before, m, place_m, before_m) -> F.Column:
    """What two sets can share at most if both prefixes hold an n-gram at these places."""
    return F.least(before, before_m) + F.least(F.col(n) - F.col(place), F.col(m) - F.col(place_m))


def _candidates(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a prefix n-gram and that neither bound rules out.

    left: token, id, root, n, place, before (n-grams of place below that other prefixes have), and of the hub that the
    set has met: hub, size, common, low, high, in_hub (the token is in the hub's prefix).
    """
    x, y = left.alias("x"), left.alias("y")
    need = _need_of(F.col("x.n"), F.col("y.n"), percent)
    room = _room("x.n", "x.place", "x.before", "y.n", "y.place", "y.before")
    bytes_of = lambda side: [F.shiftrightunsigned(f"{side}.{part}", 8 * k).bitwiseAND(F.lit(255)) for part in ("low", "high") for k in range(8)]
    lacking = sum((F.greatest(a, b) for a, b in zip(bytes_of("x"), bytes_of("y"), strict=True)), F.lit(0))
    outside = lambda side: F.col(f"{side}.n") - F.col(f"{side}.common") - F.when(F.col(f"{side}.in_hub"), F.col(f"{side}.place") - F.col(f"{side}.before")).otherwise(0)
    by_hub = F.col("x.size") - lacking + F.least(outside("x"), outside("y"))
    met_apart = F.coalesce(F.col("x.hub") != F.col("y.hub"), F.lit(True))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & (room >= need) & (met_apart | (by_hub >= need)))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _labelled_rows(df: DataFrame, width: int, percent: int, hot: int = HOT) -> DataFrame:
    """Per row of documents: doc_id, key (hash of the text), n_shingles, set_id and of its component the smallest row, head (no_id, doc_id, key)."""
    docs = base_columns(df, {"doc_id": "long", "text": "string"}).withColumn("key", F.xxhash64("text"))
    rows, counted = _first_pass(docs, width)
    cells = df.sparkSession.sparkContext.broadcast(counted)

    def prefixes(batches):
        seen: set[int] = set()  # a set goes out once per task
        names = ["deal", "token", "id", "n", "place", "cell"]
        for _, sets in _sets(batches, width):
            columns: list[list] = [[] for _ in names]
            for s in sets:
                if len(s) and (k := _set_id(s)) not in seen:
                    seen.add(k)
                    p = len(s) - -(-percent * len(s) // 100) + 1
                    token = _ordered(s, cells.value)[:p]
                    count = cells.value[_cell(token)].astype(np.int64)
                    shards = ((count - 1) // hot + 1).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        deal = token + np.uint64(k % 2**64) % shards
                    for c, v in zip(columns, (deal.view(np.int64), token.view(np.int64), np.full(p, k, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32), count), strict=True):
                        c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)
        pa.default_memory_pool().release_unused()

    def needed_sets(batches):
        for _, sets in _sets(batches, width):
            some = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in some], pa.int64()), pa.array([_ordered(s, cells.value).tobytes() for s in some], pa.binary())], ["id", "grams"])
        pa.default_memory_pool().release_unused()

    holders = rows.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("holder"))

    def verified(pairs: DataFrame, whole: bool) -> DataFrame:
        """Candidate pairs with their overlaps; their sets are made anew from the texts that hold them."""
        ids = cut_lineage(holders.join(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct(), "set_id").select("holder.*").distinct())
        small = pairs.count() <= BROADCAST_IDS
        wanted = F.broadcast(ids) if small else ids
        texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["key"] == wanted["key"]), "left_semi")
        return cut_lineage(_verify(pairs, texts.mapInArrow(needed_sets, "id long, grams binary"), percent, small, whole).distinct())

    shared = _shared_only(docs.mapInArrow(prefixes, "deal long, token long, id long, n int, place int, cell long"), hot)
    own = Window.partitionBy("id")
    ranked = shared.select("token", "id", "n", "place", (F.row_number().over(own.orderBy("place")) - 1).alias("before"), F.count("*").over(own).alias("met"))
    shared = written(ranked)  # a window holds the prefix of one set
    cls = F.log(F.col("n").cast("double")) / math.log(100 / percent)
    sized = shared.select("*", F.explode(F.array(F.floor(cls) * 2, F.floor(cls + 0.5) * 2 + 1)).alias("cls"))
    hub = F.struct("id", "n", "place", "before")
    hubs = sized.groupBy("token", "cls").agg(F.max_by(hub, F.struct(F.col("met") / F.col("n"), -F.col("id"))).alias("hub"), F.min("id").alias("low"), F.max("id").alias("high"))
    star = sized.join(hubs.where("low <> high").select("token", "cls", "hub").hint("merge"), ["token", "cls"]).where("id <> hub.id")
    star = star.withColumn("open", _room("n", "place", "before", "hub.n", "hub.place", "hub.before") >= _need_of(F.col("n"), F.col("hub.n"), percent))
    star = star.groupBy(F.col("hub.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("k"), F.bool_or("open").alias("open")).where("open")
    best = cut_lineage(star.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a")).select("a", "b"))
    met = verified(best, True)
    links = met.where(F.col("common") >= _need_of(F.col("size"), F.col("other"), percent)).select("a", "b")
    roots = components(links)

    labelled = shared.join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    labelled = labelled.join(met.drop("other").withColumnsRenamed({"a": "hub", "b": "id"}).hint("merge"), "id", "left")
    open_tokens = labelled.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("token")
    left = cut_lineage(labelled.join(open_tokens.hint("merge"), "token"))
    in_hub = shared.select("token", F.col("id").alias("hub"), F.lit(True).alias("in_hub"))
    left = left.join(in_hub.hint("merge"), ["token", "hub"], "left").withColumn("in_hub", F.coalesce("in_hub", F.lit(False)))
    done = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = cut_lineage(_candidates(left, percent).join(done.hint("merge"), ["a", "b"], "left_anti"))
    roots = components(links.unionByName(verified(cross, False).select("a", "b")))
    cells.destroy()  # all that it served is checkpointed or written

    named = holders.join(roots.withColumnRenamed("id", "set_id").hint("merge"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    heads = named.groupBy("root").agg(F.min("holder").alias("head"))
    of_set = named.join(heads.hint("merge"), "root").select("set_id", "head")
    return rows.join(of_set.hint("merge"), "set_id", "left")


def ngram_components(df: DataFrame, width: int = 4, percent: int = 85, hot: int = HOT) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included)."""
    return _labelled_rows(df, width, percent, hot).select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, columns unchanged: of each component the row with the smallest doc_id (null ids last, then by the text's hash).

    Texts without words belong to no component and stay. Of rows with equal doc_id and text one stays.
    """
    found = cut_lineage(_labelled_rows(documents, width, percent))
    other = ~(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key")))
    gone = found.where(F.col("set_id").isNotNull() & other).select(F.col("doc_id").alias("id_gone"), F.col("key").alias("key_gone")).distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(F.col("id_gone")) & (F.xxhash64(documents["text"].cast("string")) == F.col("key_gone"))
    kept = documents.join(gone, same, "left_anti")
    if found.groupBy("doc_id", "key").count().where("count > 1").take(1):
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept
