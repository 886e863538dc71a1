"""The metric log of a training run as a stream that keeps state: what was written last, the latest values, and how a metric is smoothed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that keeps this kind of state; set on the session before a query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "metric string, iteration long, value double, median double, smooth boolean, conflict boolean"


class MetricWriter(StatefulProcessor):
    """Of each metric the last written iteration, the values of the last ``window`` ones, and whether it is smoothed. What isn't newer than the last written iteration goes."""

    def __init__(self, window: int, ttl_ms: int | None = None):
        self.window, self.ttl_ms = window, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.written = handle.getValueState("written", "iteration long, smooth boolean", self.ttl_ms)
        self.history = handle.getListState("history", "value double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues=None) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["iteration", "arrived"], kind="stable")
        last, smooth = self.written.get() if self.written.exists() else (None, None)
        hints = {bool(h) for h in own["smooth"].dropna()} | ({smooth} if smooth is not None else set())
        conflict = len(hints) > 1
        smooth = next(iter(hints), None)
        own = own.drop_duplicates("iteration", keep="last")
        own = own[own["iteration"] > last] if last is not None else own
        if len(own):
            before = [v for (v,) in self.history.get()] if self.history.exists() else []
            values = np.array([*before, *own["value"]], float)
            medians = [float(np.median(values[max(0, k + 1 - self.window) : k + 1])) for k in range(len(before), len(values))]
            self.history.put([(float(v),) for v in values[-self.window + 1 :]] if self.window > 1 else [(float(values[-1]),)])
            last = int(own["iteration"].iloc[-1])
            yield pd.DataFrame({"metric": key[0], "iteration": own["iteration"], "value": own["value"], "median": medians, "smooth": smooth, "conflict": conflict})
        elif conflict:
            yield pd.DataFrame({"metric": [key[0]], "iteration": [None], "value": [None], "median": [None], "smooth": [None], "conflict": [True]})
        if last is not None:
            self.written.update((last, smooth))

    def close(self) -> None:
        pass


def written_metrics(events: DataFrame, window: int = 20, ttl_ms: int | None = None) -> DataFrame:
    """metric, iteration, value, median (of the last ``window`` written values), smooth: every iteration of a metric once, in order, from a stream of metric, iteration, value, smooth, arrived.

    Of several values of an iteration in a trigger the one that arrived last counts; an iteration that isn't newer than the metric's last written one is dropped, so rows that come
    again after a restart aren't written twice. A metric that is smoothed at one time and not at another stops the query; a null hint says nothing. With ``ttl_ms`` a metric that
    is silent for so long is forgotten. A metric's rows of one trigger are in one task; its state holds ``window`` values."""
    own = events.selectExpr("CAST(metric AS STRING) AS metric", "CAST(iteration AS LONG) AS iteration", "CAST(value AS DOUBLE) AS value", "smooth", "arrived").where("metric IS NOT NULL AND iteration IS NOT NULL")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    out = own.groupBy("metric").transformWithStateInPandas(statefulProcessor=MetricWriter(window, ttl_ms), outputStructType=_OUT, outputMode="Append", timeMode=mode)
    told = F.raise_error(F.concat(F.lit("conflicting smoothing hints for metric "), F.col("metric")))  # here rather than in the processor, whose errors leave its state server waiting
    return out.select(F.when(F.col("conflict"), told).otherwise(F.col("metric")).alias("metric"), "iteration", "value", "median", "smooth")


def append_metrics(events: DataFrame, path: str, checkpoint: str, window: int = 20, ttl_ms: int | None = None):
    """Starts a query that appends what is new to the log at ``path`` and ends when the input is read; started again with its checkpoint it goes on where it stopped."""
    spark = events.sparkSession
    spark.conf.set(*STORE)
    once = {"availableNow": True} if ttl_ms is None else {"once": True}  # with a clock, batches without rows would follow for ever
    return written_metrics(events, window, ttl_ms).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**once).start()
