"""Streams of records."""

import datetime

from pyspark.sql import functions as F
from test_records import h, rec

from readlake.operators import filters, transforms
from readlake.sinks.text import write_records
from readlake.streaming import records as st


def test_stream_equals_batch(spark, tmp_path):
    d = rec(spark, [(i, f"r{i}", "ACGT", [i] * 4, None, None, [h(mq=i)] if i % 3 else []) for i in range(40)])
    write_records(d, str(tmp_path / "in"))
    ops = [filters.filter_mapq(20), filters.require_hit(), transforms.mask_quality(25)]
    s = st.through(st.read_stream(spark, str(tmp_path / "in"), d.schema, 1), *ops)
    st.write_stream(s, str(tmp_path / "out"), str(tmp_path / "c1"))
    want = d
    for op in ops:
        want = op(want)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))
    seen = []
    st.running_stats(st.read_stream(spark, str(tmp_path / "in"), d.schema, 1), lambda b, i: seen.append(b.first().total), str(tmp_path / "c2"))
    assert seen[-1] == 40 and seen == sorted(seen)


def test_near_sorted_join(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    for k, ids in enumerate((["a", "b", "c"], ["b", "a"])):
        spark.createDataFrame([(i, f'["{i}{k}"]', at) for i in ids], "seqid string, hits string, at timestamp").write.parquet(str(tmp_path / f"in{k}"))
    parts = [spark.readStream.schema("seqid string, hits string, at timestamp").parquet(str(tmp_path / f"in{k}")) for k in (0, 1)]
    out = []
    q = st.near_sorted_join(parts).writeStream.foreachBatch(lambda b, i: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(out) == [("a", 2, '["a0", "a1"]'), ("b", 2, '["b0", "b1"]')]
    assert F is not None
