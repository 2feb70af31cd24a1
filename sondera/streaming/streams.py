"""Structured Streaming: event-time windows, count windows and keyed state, with the step functions of the batch operators.

Sources are anything that `readStream` offers; `landing()` reads a folder in which recorders put files. The bound on late rows is always explicit.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recursive import CountWindow, Ema, Kalman, Reference, SelfVerdict, noise_of


def landing(spark: SparkSession, path: str, schema, per_trigger: int | None = None, form: str = "parquet") -> DataFrame:
    """A stream of the files of a folder; per_trigger bounds how many a batch takes (back pressure)."""
    r = spark.readStream.schema(schema).format(form)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(path)


def frames_of(events: DataFrame) -> DataFrame:
    """The columns of `events` as frames, with an event-time column `at`."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return events.select(F.col("user_id").alias("source"), F.col("event_type").alias("node"), us.alias("us"), F.timestamp_micros(us).alias("at"), F.col("event_id").alias("row_no"), "value")


def tumbling(frames: DataFrame, width: str, late: str, keys: list[str]) -> DataFrame:
    w = F.window("at", width)
    g = frames.withWatermark("at", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.5)).alias("med"))
    return g.select(*keys, F.unix_micros("w.start").alias("start_us"), "n", "med")


def sliding(frames: DataFrame, width: str, slide: str, late: str, keys: list[str]) -> DataFrame:
    g = frames.withWatermark("at", late).groupBy(F.window("at", width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("value").alias("sd"))
    return g.select(*keys, F.unix_micros("w.start").alias("start_us"), "n", "sd")


def sessions(frames: DataFrame, gap: str, late: str, keys: list[str]) -> DataFrame:
    g = frames.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def heavy_hitters(frames: DataFrame) -> DataFrame:
    """Running counts of each source; no table has to overflow."""
    return frames.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"))


class NodeHealth:
    """What is kept of a node: rows of its open spans of time, its last frame, and sums for the trend of its rate."""

    def __init__(self, width: int, stall: int):
        self.width, self.stall, self.open, self.next = width, stall, {}, None
        self.us = self.row_no = self.seq = self.dropped = None
        self.sums = np.zeros(5)

    def take(self, rows: pd.DataFrame) -> None:
        for start, g in rows.groupby(rows["us"] // self.width * self.width):
            self.open.setdefault(int(start), []).append(g)

    def until(self) -> int | None:
        """The end of the next span to close."""
        start = self.next if self.next is not None else min(self.open, default=None)
        return None if start is None else start + self.width

    def close(self, now: int) -> list[dict]:
        """All spans that end by `now`, silent ones as well, in order."""
        out = []
        while (end := self.until()) is not None and end <= now:
            self.next = end
            out.append(self._row(end - self.width, end, self.open.pop(end - self.width, None)))
        return out

    def _row(self, start: int, end: int, parts: list[pd.DataFrame] | None) -> dict:
        n = sum(map(len, parts or []))
        row = {"start_us": start, "n": n, "sources": 0, "low_share": None, "rate": n * 1e6 / self.width, "spread": None, "longest_gap_us": None, "stalls": 0, "lost": None, "dropped": None, "backward": 0}
        if n:
            g = pd.concat(parts).sort_values(["us", "row_no"])
            gaps = self._steps("us", g)
            row |= {"sources": g["source"].nunique(), "low_share": float((g["value"] < 1).mean()), "spread": float(g["value"].quantile(0.75) - g["value"].quantile(0.25)), "longest_gap_us": int(gaps.max()) if len(gaps) else None, "stalls": int((gaps > self.stall).sum()), "backward": int((self._steps("row_no", g) < 0).sum())}
            if "seq" in g:
                row["lost"] = int(np.maximum(self._steps("seq", g) - 1, 0).sum())
            if "dropped" in g:  # a counter of 16 bits
                row["dropped"] = int((self._steps("dropped", g) % 65536).sum())
        x = self.sums[0]
        self.sums += (1, x, row["rate"], x * x, x * row["rate"])
        k, sx, sy, sxx, sxy = self.sums
        return row | {"silent_us": end - self.us, "trend": float((k * sxy - sx * sy) / (k * sxx - sx * sx)) if k > 1 else None}

    def _steps(self, name: str, g: pd.DataFrame) -> np.ndarray:
        """Steps of a column in order of time, from the last frame before g on."""
        x, last = g[name].to_numpy(), getattr(self, name)
        setattr(self, name, int(x[-1]))
        return np.diff(x if last is None else np.concatenate([[last], x]))


HEALTH = "start_us bigint, n bigint, sources bigint, low_share double, rate double, spread double, longest_gap_us bigint, silent_us bigint, stalls bigint, lost bigint, dropped bigint, backward bigint, trend double"


def health(frames: DataFrame, late: str, width_us: int = 86_400_000_000, stall_us: int = 3_600_000_000, seq: str | None = None, dropped: str | None = None) -> DataFrame:
    """Health of each node by span of time, once the watermark has passed the span; a span in which a node is silent has a row as well.

    Rows, sources, share of low values, frames a second, quartile range of values, longest gap between frames, silence since the last one,
    gaps over `stall_us`, numbers of the node's sequence `seq` that are missing and frames that its own queue dropped by its counter
    `dropped` (null without these), steps back of row_no in order of time,
    and the trend of the rate: its least-squares change a span, over all spans so far. Gaps and numbers go on across spans.
    """
    names = [c.split()[0] for c in HEALTH.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else NodeHealth(width_us, stall_us)  # noqa: S301  our own state
        if not state.hasTimedOut:
            s.take(pd.concat(list(parts)).drop(columns=["node", "at"]))
        out = s.close(state.getCurrentWatermarkMs() * 1000)
        state.update((pickle.dumps(s),))
        state.setTimeoutTimestamp(-(-s.until() // 1000))
        if out:
            yield pd.DataFrame([{"node": key[0], **r} for r in out], columns=["node", *names])

    f = frames.withWatermark("at", late).select("node", "source", "us", "at", "row_no", "value", *([F.col(seq).alias("seq")] if seq else []), *([F.col(dropped).alias("dropped")] if dropped else []))
    return f.groupBy("node").applyInPandasWithState(run, f"node {frames.schema['node'].dataType.simpleString()}, {HEALTH}", "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def _quantile(v: list[float], p: float) -> float:
    """Linear quantile of a few sorted values; NaN of none."""
    if not v:
        return math.nan
    i = int(at := p * (len(v) - 1))
    return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (at - i)


class SourceState:
    """What is kept of a source: its open count window, tracked value and own model."""

    def __init__(self, size: int):
        self.window, self.track, self.model, self.rate, self.last = CountWindow(size), Kalman(0.01), SelfVerdict(), Ema(0.05), None

    def step(self, row) -> dict | None:
        gap = None if self.last is None else row.us - self.last
        self.last = row.us
        if gap and gap > 0:
            self.rate.step(1e6 / gap)
        full = self.window.step((row.us, row.value))
        if full is None:
            return None
        v = sorted(float(x) for _, x in full if x is not None and x == x)
        iqr, med = _quantile(v, 0.75) - _quantile(v, 0.25), _quantile(v, 0.5)
        return {"us": int(full[-1][0]), "med": med, "iqr": iqr, "tracked": self.track.step(med, noise_of(iqr, 1.0)), "verdict": self.model.step(med, iqr)}


class Frame(NamedTuple):
    us: int
    value: float


WINDOWS = "source bigint, us bigint, med double, iqr double, tracked double, verdict string"


def live_windows(frames: DataFrame, size: int = 8) -> DataFrame:
    """Count windows of each source, with its tracked value and verdict, from state that a checkpoint keeps, open windows included.

    Rows of a source are taken in the order of their time inside a batch, and batches in order of arrival.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = pickle.loads(state.get[0]) if state.exists else SourceState(size)  # noqa: S301  our own state
        rows = sorted((r for p in parts for r in zip(p["us"].tolist(), p["row_no"].tolist(), p["value"].tolist(), strict=True)), key=lambda r: r[:2])
        out = [w for us, _, value in rows if (w := s.step(Frame(us, value))) is not None]
        state.update((pickle.dumps(s),))
        if out:
            yield pd.DataFrame({"source": key[0], **{c: [w[c] for w in out] for c in out[0]}})

    return frames.select("source", "us", "row_no", "value").groupBy("source").applyInPandasWithState(run, WINDOWS, "state binary", "append", GroupStateTimeout.NoTimeout)


def live_reference(windows: DataFrame, reference: str) -> DataFrame:
    """Windows (node, source, us, med) less their node's tracked reference source, in order of arrival. A node's windows, a few a second, share one state."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ref = pickle.loads(state.get[0]) if state.exists else Reference(reference)  # noqa: S301  our own state
        rows = pd.concat(list(parts)).sort_values(["us", "source"])
        out = [{"node": key[0], "source": r.source, "us": r.us, "corrected": ref.step(r.source, r.med)} for r in rows.itertuples(index=False)]
        state.update((pickle.dumps(ref),))
        yield pd.DataFrame(out, columns=["node", "source", "us", "corrected"])

    return windows.groupBy("node").applyInPandasWithState(run, "node string, source string, us bigint, corrected double", "state binary", "append", GroupStateTimeout.NoTimeout)


def calibrated(frames: DataFrame, states: DataFrame, late: str = "1 minute", valid: str = "10 minutes") -> DataFrame:
    """Frames of nodes whose last status within `valid` says that calibration is done: a stream-stream join with bounded state."""
    f = frames.withWatermark("at", late)
    s = states.where("calibration = 1").select(F.col("node").alias("__node"), F.col("at").alias("__at")).withWatermark("__at", late)
    near = (F.col("node") == F.col("__node")) & (F.col("__at") <= F.col("at")) & (F.col("at") <= F.expr(f"__at + INTERVAL {valid}"))
    return f.join(s, near, "left_semi")


def batch_windows(frames: DataFrame, size: int = 8) -> DataFrame:
    """live_windows() over a table: the same steps from a fresh state."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = SourceState(size)
        out = [{"source": key[0], **w} for r in pdf.sort_values(["us", "row_no"]).itertuples(index=False) if (w := s.step(r)) is not None]
        return pd.DataFrame(out, columns=[c.split()[0] for c in WINDOWS.split(", ")]) if out else pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in WINDOWS.split(", ")})

    return frames.select("source", "us", "row_no", "value").groupBy("source").applyInPandas(run, WINDOWS)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet, and give what it wrote. A second call goes on where the first ended."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:  # each batch replaces the whole result
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_live(stream: DataFrame, path: str, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Run a stream on and on, committing what it has every so often; a view that is drawn faster reads the last commit. The caller stops it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
