"""What a bucket of a stream's state holds at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewire.registry import streams
from tidewire.streaming import kept, segments, topics

COLUMNS = [*segments._HERE, "event_type", "ms", "n"]


def rows(message, container, stage, ms, n=1):
    return ("s", "t", "r", message, "a", container, stage, ms, n)


def test_buckets_follow_the_rows_of_a_step(spark, monkeypatch):
    monkeypatch.setattr(kept, "ROWS_PER_BUCKET", 7)
    asked = {}

    def spy(events, **how):
        asked.update(how)
        raise InterruptedError

    monkeypatch.setattr(streams, "stream_segments", spy)
    with pytest.raises(InterruptedError):
        streams.stream_latency_samples(spark, "/root/testdata/sf0.001")
    dealt = streams.event_rows(spark, "/root/testdata/sf0.001").selectExpr(f"{streams._DELAYED} AS step")
    most = max(r["count"] for r in dealt.groupBy("step").count().collect())
    assert asked["buckets"] > kept.FEWEST_BUCKETS and 0 <= asked["buckets"] * 7 - most < 7


def test_a_hot_message_is_paired_in_bounded_memory():
    new = [rows("m", f"p{c}", "Publication", t) for c in range(80) for t in range(30)]
    new += [rows("m", f"c{c}", "Reception", t) for c in range(80) for t in range(30)]
    empty = segments._KEPT.empty_table().to_pandas()
    new = pd.DataFrame(new, columns=COLUMNS)
    segments.pair_step(empty, new.head(2), 0)
    tracemalloc.start()
    try:
        out, held = segments.pair_step(empty, new, 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out["weight"].sum() == 2400 * 2400 and len(held) == 4800
    assert set(out["segment"]) == {"publication_to_reception"} and len(out) == 30 * 31 // 2
    # Some 400,000 pairs at once; all of them would take several hundred MB.
    assert peak < 100e6


def test_tasks_follow_the_rows_of_a_step(spark, tmp_path):
    events = pd.DataFrame([rows(f"m{k}", "c", "Reception", k)[:7] for k in range(50)], columns=COLUMNS[:7])
    events["timestamp"] = pd.Timestamp("2024-01-01", tz="UTC")
    spark.createDataFrame(events).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    pairs = segments.stream_segments(stream, lateness="9 seconds", horizon_ms=9000)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    n = kept.partitions_for(6 * kept.ROWS_PER_PARTITION + 1)
    topics.drain_to_parquet(pairs, f"{tmp_path}/out", f"{tmp_path}/cp", partitions=n)
    assert n == 7 and len([p for p in (tmp_path / "cp/state/0").iterdir() if p.name.isdigit()]) == 7
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_copies_are_combined_as_they_come(monkeypatch):
    monkeypatch.setattr(kept, "WAITING_ROWS", 100)
    seen = []

    def combine(parts):
        seen.append(sum(map(len, parts)))
        return segments.combine_rows(parts)

    parts = (pd.DataFrame([rows(f"m{k % 3}", None, "Reception", k % 5)] * 10, columns=COLUMNS) for k in range(600))
    new = kept.collected(parts, combine)
    assert len(new) == 15 and new["n"].sum() == 6000 and max(seen) <= 400
    assert sorted(new["message_id"].unique()) == ["m0", "m1", "m2"] and new["container_name"].isna().all()
    assert kept.collected(iter([]), combine) is None


def test_a_state_forgets_the_texts_of_rows_that_fell_out():
    held = segments.combine_rows(
        [pd.DataFrame([rows(f"m{k}", None, "Reception", k) for k in range(1000)], columns=COLUMNS)]
    )
    packed = kept._pack(held[held["ms"] >= 998], segments._KEPT)
    back = kept._unpack(packed)
    assert list(back["message_id"].cat.categories) == ["m998", "m999"] and back["container_name"].isna().all()
    assert list(back["message_id"]) == ["m998", "m999"] and len(packed) < 4000


def test_numbers_of_combinations_keep_their_order_beyond_64_bits():
    rng = np.random.default_rng(3)
    wide = [rng.choice([-1, 0, 5, 1 << 20, 1 << 22], 200).astype("int32") for _ in range(5)]
    got = segments._numbered(*wide)
    tuples = list(zip(*[c.tolist() for c in wide]))
    assert len(set(got.tolist())) == len(set(tuples))
    assert sorted(range(200), key=lambda i: tuples[i]) == sorted(range(200), key=lambda i: int(got[i]))
    assert len(segments._numbered(np.empty(0, "int32"), np.empty(0, "int32"))) == 0


def test_texts_are_coded_from_either_form():
    plain = pd.Series(["b", None, "a", "b"])
    for texts in (plain, plain.astype("category"), pd.Categorical(plain, ["x", "b", "a"])):
        assert kept.coded(pd.Series(texts)).to_pylist() == ["b", None, "a", "b"]
    assert kept.coded(pd.Series([], dtype="category")).type == pa.dictionary(pa.int32(), pa.string())
