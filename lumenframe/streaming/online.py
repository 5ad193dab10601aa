"""The online noise model as a stream: robust statistics per key that outlive a micro-batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import ensure_checkpoint_dir

STATE = "n long, mean double, m2 double, clipped long"


def fold(n: int, mean: float, m2: float, clipped: int, values: np.ndarray, k: float = 5.0, least: int = 4) -> tuple[int, float, float, int]:
    """Fold values one by one: cut what lies above mean + k deviations, then learn it."""
    for x in values:
        if n >= least and m2 > 0:
            top = mean + k * (m2 / (n - 1)) ** 0.5
            if x > top:
                x, clipped = top, clipped + 1
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
    return n, float(mean), float(m2), clipped


def online_noise(stream: DataFrame, key: str, order: list[str], value: str, k: float = 5.0, least: int = 4) -> DataFrame:
    """``key, n, mean, var, clipped`` of each key that a micro-batch touched, after it (update mode).

    Values of a batch are folded in ``order``; batches follow each other. NULL values are skipped.
    """
    kind = stream.schema[key].dataType.simpleString()

    def kernel(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = state.get if state.exists else (0, 0.0, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        s = fold(*s, rows["x"].dropna().to_numpy(float), k, least)
        state.update(s)
        n, mean, m2, clipped = s
        yield pd.DataFrame({key: [name[0]], "n": [n], "mean": [mean], "var": [m2 / (n - 1) if n >= 2 else 0.0], "clipped": [clipped]})

    rows = stream.select(key, *order, F.col(value).cast("double").alias("x"))
    return rows.groupBy(key).applyInPandasWithState(kernel, f"{key} {kind}, n long, mean double, var double, clipped long", STATE, "update", "NoTimeout")


def online_scores(stream: DataFrame, key: str, order: list[str], value: str, k: float = 5.0, least: int = 4, warmup: int = 16) -> DataFrame:
    """``key, order…, n, z`` of each arriving value, scored against the running state (append mode).

    A value is folded in before it is scored, so it is whitened against statistics that include it. When
    ``warmup`` values of a key have been learned, the key is committed as valid or not (it does not
    vary); from then on z is NULL for keys that are not. NULL values are skipped.
    """
    kind = stream.schema[key].dataType.simpleString()
    kinds = ", ".join(f"{o} {stream.schema[o].dataType.simpleString()}" for o in order)

    def kernel(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        *s, valid = state.get if state.exists else (0, 0.0, 0.0, 0, True)
        rows = pd.concat(list(batches)).dropna(subset=["x"]).sort_values(order, kind="stable")
        n, z = [], []
        for x in rows["x"].to_numpy(float):
            s = fold(*s, np.array([x]), k, least)
            var = s[2] / (s[0] - 1) if s[0] >= 2 else 0.0
            if s[0] == warmup:
                valid = var > 0
            n.append(s[0])
            z.append((x - s[1]) / max(var, 1e-12) ** 0.5 if valid else None)
        state.update((*s, valid))
        yield rows[order].assign(**{key: name[0], "n": n, "z": pd.Series(z, index=rows.index, dtype=float)})[[key, *order, "n", "z"]]

    rows = stream.select(key, *order, F.col(value).cast("double").alias("x"))
    return rows.groupBy(key).applyInPandasWithState(kernel, f"{key} {kind}, {kinds}, n long, z double", STATE + ", valid boolean", "append", "NoTimeout")


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Drain a finite stream in append mode into a table of the shared folder."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_to_end(stream: DataFrame, key: str, spark: SparkSession, newest: str = "n") -> DataFrame:
    """Drain a finite stream in update mode into a table of the shared folder; the last row per key."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(f"{base}/out")
    others = [c for c in stream.columns if c != key]
    return got.groupBy(key).agg(F.max_by(F.struct(*others), newest).alias("s")).select(key, "s.*")


def running_windows(events: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean per event-time window, with a watermark for late rows (batch or stream)."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp"))
    return timed.withWatermark("__t", late).groupBy(F.window("__t", width)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
