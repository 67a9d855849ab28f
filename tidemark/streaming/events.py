"""Structured Streaming twins of the batch windows, and a keyed state with updates.

Each function takes and gives a streaming DataFrame. ``run_to_end`` drives a query over all rows that are there
and leaves the last version of its result in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.runtime import _checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern makes a single file a folder's listing."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")
    # event time must be an instant
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def tumbling(events: DataFrame, keys: list[str], ts: str, width: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """(key, n, last_us, value): the state of each key after every batch; a later row takes the place of the one before."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, held = state.get if state.exists else (0, -1, None)
        for pdf in batches:
            n += len(pdf)
            top = pdf.sort_values(["us", "value"]).iloc[-1]
            if (int(top["us"]), str(top["value"])) >= (last, held or ""):
                last, held = int(top["us"]), str(top["value"])
        state.update((n, last, held))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "last_us": [last], "value": [held]})

    rows = events.select(F.col(key).cast("long").alias("key"), F.unix_micros(ts).alias("us"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, "key long, n long, last_us long, value string", "n long, last_us long, value string", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The result after all rows that are there. In ``complete`` mode the last batch holds it; in others ``merge`` joins the batches."""
    spark = stream.sparkSession
    _checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        # a batch that is repeated after a failure overwrites itself
        df.write.mode("overwrite").parquet(f"{base}/out/{'last' if mode == 'complete' else f'batch={batch}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{base}/out/last" if mode == "complete" else f"{base}/out/*")
    return merge(out) if merge else out
