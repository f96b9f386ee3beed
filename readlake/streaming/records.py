"""Streams of records."""

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from readlake.operators import stats as batch

#: How long after its last arrival a read waits for further inputs.
LINGER_MS = 3_600_000
JOINED = "seqid string, inputs int, hits string"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Records as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def through(df: DataFrame, *ops: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream through row-local operators (filters, masks, trims); an operator that isn't is an error of the stream itself."""
    for op in ops:
        df = df.transform(op)
    return df


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Appends a stream to Parquet files, exactly once, as far as there is input now."""
    q = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return q


def running_stats(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Statistics of all records so far, handed to sink after each batch."""
    q = batch.stats(df).writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _joiner(inputs: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, hits = (set(), []) if not state.exists else (lambda s: (set(s["i"]), s["h"]))(json.loads(state.get[0]))
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"seqid": [key[0]], "inputs": [len(seen)], "hits": [json.dumps(sorted(hits))]})
            return
        last = 0 if not state.exists else json.loads(state.get[0])["t"]
        for f in frames:
            last = max(last, int(f["at"].max().timestamp() * 1000))
            for i, h in zip(f["input"], f["hits"], strict=True):
                seen.add(int(i))
                hits += json.loads(h)
        if len(seen) >= inputs:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"seqid": [key[0]], "inputs": [len(seen)], "hits": [json.dumps(sorted(hits))]})
        else:
            state.update((json.dumps({"i": sorted(seen), "h": hits, "t": last}),))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + LINGER_MS)

    return step


def near_sorted_join(parts: Sequence[DataFrame], delay: str = "1 hour") -> DataFrame:
    """seqid, inputs, hits (JSON list): reads of several streams joined on seqid. A read is emitted once all inputs have it, or, as a leftover, when the
    watermark is an hour past its last arrival. Each stream has seqid, hits (JSON list of texts) and at (event time)."""
    tagged = None
    for i, p in enumerate(parts):
        one = p.select("seqid", "hits", "at", F.lit(i).alias("input")).withWatermark("at", delay)
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("seqid").applyInPandasWithState(_joiner(len(parts)), JOINED, "state string", "append", GroupStateTimeout.EventTimeTimeout)
