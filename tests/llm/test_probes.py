"""Names that clash, damaged media, very long texts and high rates."""

import math
import struct
import time

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from capturelake.llm import bpe, media, mixing, secrets, suffix_dedup, toxicity


def test_mixing_keeps_any_column(spark):
    rows = [(i, f"t{i}", "a" if i % 3 else "b", i, i + 1, i + 2, i + 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _source int, _n int, salt int, cdf int")
    got = mixing.mix(df.withColumn("replica", F.lit(9)).withColumn("mix_key", F.lit(9)))
    assert got.columns == [*df.columns, "replica", "mix_key"]
    out = got.collect()
    assert out and all(r._source + 1 == r._n == r.salt - 1 == r.cdf - 2 for r in out) and {r.replica for r in out} >= {1}


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 40.0, 900.0, 20_000.0])
def test_poisson_table(spark, rate):
    row = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).first().t
    k = row.base + len(row.cdf) // 2
    want = sum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1))
    assert abs(row.cdf[len(row.cdf) // 2] - want) < 1e-9 and abs(row.cdf[-1] - 1) < 1e-9 and len(row.cdf) < 30 * math.sqrt(rate) + 60


def test_redaction_keeps_any_column(spark):
    df = spark.createDataFrame([(1, "x token=abcdef y", 1, 2, 3, 4, 5)], "doc_id long, text string, base_spans int, all_spans int, _runs int, row int, hit int")
    assert [tuple(r) for r in secrets.redact(df).collect()] == [(1, "x [SECRET] y", 1, 2, 3, 4, 5)]


def test_secrets_of_a_long_text(spark):
    text = " ".join(f"{i:024x}" for i in range(40_000))
    df = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    secrets.redact(df).count()
    began = time.time()
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert out == {1: " ".join(["[SECRET]"] * 40_000), 2: "plain"} and time.time() - began < 60


def test_segments_of_a_long_text():
    began = time.time()
    assert len(toxicity.maximal_segments([1.0, -2.0] * 200_000)) == 200_000 and toxicity.maximal_segments([2.0, -1.0] * 200_000) == [(0, 399_999, 200_001.0)]
    assert time.time() - began < 5


def test_media_of_several_tracks_and_damage():
    def track(ident, first, size, count, keys):
        table = [media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", b"\0" * 70)), media.full(b"stts", struct.pack(">III", 1, count, 10)), media.full(b"stsc", struct.pack(">IIII", 1, 1, count, 1)), media.full(b"stsz", struct.pack(">II", size, count)), media.full(b"stco", struct.pack(">II", 1, first))]
        if keys is not None:
            table.append(media.full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)))
        head = media.full(b"tkhd", struct.pack(">IIIII", 0, 0, ident, 0, 0))
        return media.box(b"trak", head, media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 100, min(count * 10, 2**32 - 1))), media.box(b"minf", media.box(b"stbl", *table))))

    def file(*tracks):
        return media.box(b"moov", *tracks) + b"d" * 4000

    both = media.tracks(file(track(1, 1000, 10, 53, None), track(2, 2000, 10, 20, [1, 6, 11, 16, 20])))
    assert [(t["samples"], len(t["keys"]), t["duration"]) for t in both] == [(53, 53, 530), (20, 5, 200)]
    beyond = file(track(1, 1000, 10, 2**31, None))
    assert media.track_table(beyond)["samples"] == (len(beyond) - 1000) // 10
    deep = b""
    for _ in range(2_000):
        deep = media.box(b"moov", deep)
    assert media.track_table(deep) is None and sum(1 for _ in media.walk(deep)) == 2_000
    whole = file(track(1, 1000, 10, 5, None))
    for cut in range(0, 500, 3):
        media.tracks(whole[:cut])
        media.tracks(whole[:cut] + b"\xff" * 40 + whole[cut:])
    short = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd", b"\0\0\0"))))
    assert media.track_table(short) is None


def test_media_fragments():
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", b"\0" * 70)))
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, 7)), media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)), media.box(b"minf", stbl)))
    moov = media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 7, 1, 40, 0, 0x10000))))
    sizes = [30, 5, 6]
    run = lambda offset: media.full(b"trun", struct.pack(">IiI", 3, offset, 0), *(struct.pack(">I", n) for n in sizes), flags=0x205)
    moof = lambda offset: media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7)), run(offset)))
    data = moov + moof(len(moof(0)) + 8) + media.box(b"mdat", b"x" * 41)
    got = media.track_table(data)
    start = len(data) - 41
    assert (got["codec"], got["samples"], got["ticks"], got["keys"], got["spans"]) == ("avc1", 3, 120, [(start, start + 30)], [[start, start + 41]])


def test_bpe_ids_outside_the_vocabulary():
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    known = codec.decode_any([5, 6])
    assert codec.decode_any([5, 10**9, -1, None, 6]) == codec.decode([5]) + b"\xef\xbf\xbd" * 3 + codec.decode([6]) and known == codec.decode([5]) + codec.decode([6])


def test_suffix_dedup_refuses_what_it_cannot_place():
    import numpy as np

    with pytest.raises(ValueError, match="256 MB"):
        suffix_dedup.records(np.zeros(2**28 + 1, np.uint8), np.array([0, 2**28 + 1]), 200)


def test_a_stage_drops_the_tables_that_another_left_in_a_worker(spark):
    from capturelake.llm import common
    from capturelake.llm.queries import RANKS

    path = public_tokenizers.path(RANKS)

    def run(batches):  # one worker serves both stages in turn
        held = []
        with common.worker_memory("byte_bpe", bpe.codec.cache_clear):
            bpe.codec(path, public_tokenizers.PATTERN)
        with common.worker_memory("byte_bpe", bpe.codec.cache_clear):
            held.append(bpe.codec.cache_info().currsize)
        with common.worker_memory("toxicity"):
            held.append(bpe.codec.cache_info().currsize)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held] * len(batch))], ["held"])

    assert spark.range(0, 1, 1, 1).mapInArrow(run, "held array<long>").first().held == [1, 0]
