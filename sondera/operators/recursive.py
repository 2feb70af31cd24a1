"""Step functions with state, shared by batch (ordered groups) and streams (state stores).

A step takes the state and one row and gives the next state and what to emit. In batch a key's rows are sorted and walked; keys
are one source each. A source is walked by one task, which is what a recursion asks for; sources spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .models import FLOOR_X, FLOOR_Y, LEAST_ROWS, MARGINAL, MATCH


@dataclass
class Kalman:
    """A random walk seen through noise. q: variance of its step."""

    q: float
    x: float | None = None
    p: float = 1.0

    def step(self, z: float, r: float) -> float:
        if self.x is None:
            self.x, self.p = z, r
        else:
            self.p += self.q
            gain = self.p / (self.p + r)
            self.x += gain * (z - self.x)
            self.p *= 1 - gain
        return self.x


def noise_of(iqr: float | None, floor: float) -> float:
    """Variance that a normal sample with this interquartile range has."""
    return max(((iqr or 0.0) / 1.35) ** 2, floor)


@dataclass
class Ema:
    alpha: float
    value: float | None = None

    def step(self, x: float) -> float:
        self.value = x if self.value is None else self.value + self.alpha * (x - self.value)
        return self.value


@dataclass
class Hysteresis:
    """On when the second largest score is over `second`, or the largest over `top`, for `on` steps; off when the largest is under `low` for `off` steps.

    A link without a score counts as lowest. Where there is one link in all, its score is the second largest as well.
    """

    second: float = 5.0
    top: float = 12.0
    low: float = 3.0
    on: int = 10
    off: int = 50
    active: bool = False
    run: int = 0

    def step(self, scores: list[float | None], links: int | None = None) -> bool:
        s = sorted((x for x in scores if x is not None and math.isfinite(x)), reverse=True)
        first = s[0] if s else -math.inf
        second = first if (links or len(scores)) == 1 else s[1] if len(s) > 1 else -math.inf
        wants = first < self.low if self.active else second > self.second or first > self.top
        self.run = self.run + 1 if wants else 0
        if self.run >= (self.off if self.active else self.on):
            self.active, self.run = not self.active, 0
        return self.active


@dataclass
class Anchor:
    """Wall clock from a device clock: anchored at the first row, anew when both drift apart by more than `limit_us`."""

    limit_us: int = 5_000_000
    wall: int | None = None
    device: int | None = None

    def step(self, wall: int, device: int) -> tuple[int, bool]:
        if self.wall is not None:
            t = self.wall + device - self.device  # type: ignore[operator]
            if abs(t - wall) <= self.limit_us:
                return t, False
        self.wall, self.device = wall, device
        return wall, True


@dataclass
class Reference:
    """Subtracts a tracked reference source from all others, null until it was seen. The reference's own rows move the track first, and become what they still differ from it."""

    source: str
    q: float = 0.01
    r: float = 1.0
    track: Kalman = field(init=False)

    def __post_init__(self) -> None:
        self.track = Kalman(self.q)

    def step(self, source: str, value: float, r: float | None = None) -> float | None:
        if source == self.source:
            self.track.step(value, self.r if r is None else r)
        return None if self.track.x is None else value - self.track.x


@dataclass
class SelfVerdict:
    """A source's own model of two features, and whether a new window fits it: LEARNING, STABLE, DRIFTING, ANOMALY, or REBASE after a run of anomalies.

    The model is a running mean and covariance, with floors under the variances; anomalies don't go into it.
    """

    least: int = LEAST_ROWS
    drift: float = MATCH
    limit: float = MARGINAL
    patience: int = 20
    floors: tuple[float, float] = (FLOOR_X, FLOOR_Y)
    n: int = 0
    mx: float = 0.0
    my: float = 0.0
    xx: float = 0.0
    yy: float = 0.0
    xy: float = 0.0
    streak: int = 0

    def distance2(self, x: float, y: float) -> float:
        k = max(self.n - 1, 1)
        vx, vy, c = max(self.xx / k, self.floors[0]), max(self.yy / k, self.floors[1]), self.xy / k
        dx, dy, det = x - self.mx, y - self.my, vx * vy - c * c
        return (vy * dx * dx - 2 * c * dx * dy + vx * dy * dy) / det if det else math.inf

    def step(self, x: float, y: float) -> str:
        if self.n < self.least:
            verdict = "LEARNING"
        elif (d2 := self.distance2(x, y)) > self.limit:
            self.streak += 1
            if self.streak < self.patience:
                return "ANOMALY"
            self.n, self.mx, self.my, self.xx, self.yy, self.xy, verdict = 0, 0.0, 0.0, 0.0, 0.0, 0.0, "REBASE"
        else:
            verdict = "DRIFTING" if d2 > self.drift else "STABLE"
        self.streak = 0
        self.n += 1
        dx, dy = x - self.mx, y - self.my
        self.mx += dx / self.n
        self.my += dy / self.n
        self.xx += dx * (x - self.mx)
        self.xy += dx * (y - self.my)
        self.yy += dy * (y - self.my)
        return verdict


@dataclass
class CountWindow:
    """Collects `size` rows, then gives them and begins anew."""

    size: int
    rows: list = field(default_factory=list)

    def step(self, row) -> list | None:
        self.rows.append(row)
        if len(self.rows) < self.size:
            return None
        out, self.rows = self.rows, []
        return out


def walk(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, reads: list[str], schema: str, writes: list[str]) -> DataFrame:
    """(keys, order, writes) of each row: step(state, *reads) gives the values of `writes`, and a key's rows are walked in order from a fresh state.

    Keys are dealt to tasks and sorted there by Spark, which spills; Python sees one Arrow batch at a time and carries only the state
    of the key it is in, so a key may have any number of rows. schema names the types of `writes`.
    """
    src = df.select(*keys, *order, *[c for c in reads if c not in (*keys, *order)]).repartition(*keys).sortWithinPartitions(*keys, *order)
    into = T.StructType([*[src.schema[c] for c in (*keys, *order)], *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            at = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
            out = []
            for key, *row in zip(at, *(b.column(b.schema.get_field_index(c)).to_pylist() for c in reads), strict=True):
                if key != last:
                    last, state = key, start()
                out.append(step(state, *row))
            new = zip(*out, strict=True) if out else [[] for _ in writes]
            columns = [b.column(b.schema.get_field_index(c)) for c in (*keys, *order)]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(list(v), arrow.field(c).type) for c, v in zip(writes, new, strict=True)]], schema=arrow)

    return src.mapInArrow(run, into)
