"""Table functions for SQL text: they take a table, partitioned by device and ordered, and give rows of their own.

Spark deals the partitions and sorts them; a function sees one device's pings in order and keeps only what its next row needs (a run's
coordinates, the pings of a burst window). For tables in which one device has most of the rows, call `traces.line_segments`, which
cuts devices into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

LINE = "maid string, kind string, segment long, n long, start long, end long, label string, coordinates array<array<double>>"


class TraceSegments:
    """trace_segments(TABLE(...) PARTITION BY maid ORDER BY (timestamp, seq)): move and gap lines as `traces.line_segments` gives them,
    with gaps of over 30 minutes and labels from 60 minutes on. The table holds maid, timestamp, longitude and latitude; pings without a
    time come first and belong to the first run."""

    GAP, LABEL = 1800, 3600

    def __init__(self) -> None:
        self.maid: str | None = None
        self.segment, self.path = 0, []
        self.start: int | None = None
        self.last: int | None = None

    @staticmethod
    def _rounded(x: float | None) -> float | None:
        from decimal import ROUND_HALF_EVEN, Decimal

        return None if x is None else float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_EVEN))

    def _move(self) -> Iterator[tuple]:
        if len(self.path) > 1:
            yield self.maid, "move", self.segment, len(self.path), self.start, self.last, "", self.path

    def eval(self, row: Row) -> Iterator[tuple]:
        at, now = [self._rounded(row["longitude"]), self._rounded(row["latitude"])], row["timestamp"]
        if self.last is not None and now - self.last > self.GAP:
            yield from self._move()
            self.segment += 1
            minutes = (now - self.last) // 60
            label = f"+{minutes // 60}h {minutes % 60:02d}m" if now - self.last >= self.LABEL else ""
            yield self.maid, "gap", self.segment, 2, self.last, now, label, [self.path[-1], at]
            self.path, self.start = [], None
        self.maid = row["maid"]
        self.path.append(at)
        self.start = now if self.start is None else self.start
        self.last = now

    def terminate(self) -> Iterator[tuple]:
        yield from self._move()


class BurstFeatures:
    """burst_features(TABLE(...) PARTITION BY maid ORDER BY (timestamp, seq)): runs of pings of which each comes at most 60 seconds after
    the one before: maid, start, end, n, and the mean seconds between its pings (null for a single one)."""

    GAP = 60
    RESULT = "maid string, start long, end long, n long, mean_gap double"

    def __init__(self) -> None:
        self.maid: str | None = None
        self.start, self.last, self.n = None, None, 0

    def _burst(self) -> Iterator[tuple]:
        if self.n:
            yield self.maid, self.start, self.last, self.n, (self.last - self.start) / (self.n - 1) if self.n > 1 else None

    def eval(self, row: Row) -> Iterator[tuple]:
        now = row["timestamp"]
        if now is None:
            return
        if self.last is not None and now - self.last > self.GAP:
            yield from self._burst()
            self.start, self.n = None, 0
        self.maid, self.last, self.n = row["maid"], now, self.n + 1
        self.start = now if self.start is None else self.start

    def terminate(self) -> Iterator[tuple]:
        yield from self._burst()


def register(spark: SparkSession) -> None:
    spark.udtf.register("trace_segments", udtf(TraceSegments, returnType=LINE))
    spark.udtf.register("burst_features", udtf(BurstFeatures, returnType=BurstFeatures.RESULT))
