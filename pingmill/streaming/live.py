"""Structured Streaming forms of occupancy, sessions, the speed filter, gap lines and ingest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pingmill.functions.cells import DEFAULT
from pingmill.operators import contacts
from pingmill.sources.ingest import typed_pings
from pingmill.sources.schemas import RAW_PING


def occupancy(stream: DataFrame, width: str = "1h", late: str = "1 hour", index=DEFAULT) -> DataFrame:
    """Distinct devices and pings by (window, cell) of a stream(maid, longitude, latitude, at timestamp): exact, in two stateful steps.

    Pings are counted by device first; a window's devices are then counted when the first step lets it go.
    """
    step = f"{contacts.seconds(width)} seconds"
    rows = stream.withWatermark("at", late).select("at", "maid", index.cell(F.col("longitude"), F.col("latitude")).alias("cell"))
    devices = rows.groupBy(F.window("at", step).alias("w"), "cell", "maid").agg(F.count("*").alias("n"))
    return devices.groupBy(F.window(F.window_time("w"), step).alias("bucket"), "cell").agg(F.count("*").alias("n_devices"), F.sum("n").alias("n_pings"))


def sliding_counts(stream: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour", index=DEFAULT) -> DataFrame:
    """Pings by (sliding window, cell)."""
    cell = index.cell(F.col("longitude"), F.col("latitude")).alias("cell")
    return stream.withWatermark("at", late).groupBy(F.window("at", width, slide).alias("bucket"), cell).agg(F.count("*").alias("n_pings"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a device's pings with no gap over `gap`."""
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("session"), "maid").agg(F.count("*").alias("n_pings"))


def _too_fast(df: pd.DataFrame, last: tuple | None, max_kph: float, min_gap_min: float) -> np.ndarray:
    """Flags of rows in order, the first compared with `last` (longitude, latitude, timestamp)."""
    before = df[["longitude", "latitude", "timestamp"]].shift(1).astype(float)
    if last is not None:
        before.iloc[0] = last
    a, b = np.radians(before["latitude"]), np.radians(df["latitude"])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(df["longitude"] - before["longitude"]) / 2) ** 2
    km, minutes = 2 * 6371.0 * np.arcsin(np.minimum(1, np.sqrt(h))), (df["timestamp"] - before["timestamp"]) / 60
    return ((minutes > 0) & (minutes >= min_gap_min) & (km > max_kph * minutes / 60)).fillna(False).to_numpy()


class LastPing(StatefulProcessor):
    """Flags pings as they come; keeps the newest ping of a device. A ping older than that is compared with what came before it in its
    own batch only, and never takes the newest one's place."""

    def __init__(self, max_kph: float = 120.0, min_gap_min: float = 0.1):
        self.limits = max_kph, min_gap_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "longitude double, latitude double, timestamp long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["timestamp", "seq"], kind="stable")
        last = tuple(self.last.get()) if self.last.exists() else None
        newer = df["timestamp"] >= last[2] if last else pd.Series(True, df.index)
        for part, before in ((df[~newer], None), (df[newer], last)):
            if len(part):
                yield part[["maid", "seq", "timestamp"]].assign(is_outlier=_too_fast(part, before, *self.limits))
        if newer.any():
            end = df.iloc[-1]
            self.last.update((float(end["longitude"]), float(end["latitude"]), int(end["timestamp"])))

    def close(self) -> None:
        pass


class InOrder(StatefulProcessor):
    """Holds a device's pings back until the watermark has passed them, and hands them to `take` in the order of (timestamp, seq).

    A ping at or before the watermark is late: it is left out, so what was handed out is never overtaken.
    """

    HELD = "timestamp long, seq long, longitude double, latitude double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.HELD)
        self.passed = handle.getValueState("passed", "timestamp long")

    def take(self, key, ready: list[tuple], passed: int) -> Iterator[pd.DataFrame]:
        """ready: rows of HELD, all that come before any row not yet handed out; passed: the watermark in whole seconds."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.HELD.split(", ")]
        # Spark itself compares with the watermark of the batch before.
        passed = max(timerValues.getCurrentWatermarkInMs() // 1000, self.passed.get()[0] if self.passed.exists() else -1)
        new = [(int(t), int(q), float(x), float(y)) for part in rows for t, q, x, y in part[names].itertuples(index=False) if t > passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[0] for r in new) * 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        self.passed.update((passed,))
        rest = [r for r in rows if r[0] > passed]
        if rest:
            self.waiting.put(rest)
        elif rows:
            self.waiting.clear()
        yield from self.take(key, rows[: len(rows) - len(rest)], passed)

    def close(self) -> None:
        pass


class Speeds(InOrder):
    """The flags of LastPing, of pings in order."""

    def __init__(self, max_kph: float = 120.0, min_gap_min: float = 0.1):
        self.limits = max_kph, min_gap_min

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "longitude double, latitude double, timestamp long")

    def take(self, key, ready, passed) -> Iterator[pd.DataFrame]:
        if ready:
            df = pd.DataFrame(ready, columns=["timestamp", "seq", "longitude", "latitude"])
            flags = _too_fast(df, tuple(self.last.get()) if self.last.exists() else None, *self.limits)
            self.last.update((ready[-1][2], ready[-1][3], ready[-1][0]))
            yield df.assign(maid=key[0], is_outlier=flags)[["maid", "seq", "timestamp", "is_outlier"]]


LINE = "maid string, kind string, segment long, n long, start long, end long, label string, coordinates array<array<double>>"


class Gaps(InOrder):
    """Move and gap lines: a run is closed by the first ping after a longer gap, or by the watermark once no such ping can join it."""

    def __init__(self, gap_min: float = 30, label_min: float = 60):
        self.gap, self.label = int(gap_min * 60), int(label_min * 60)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "segment long, start long, last long, x double, y double, n long")
        self.run = handle.getListState("run", "x double, y double")

    def take(self, key, ready, passed) -> Iterator[pd.DataFrame]:
        lines: list[tuple] = []
        state = tuple(self.open.get()) if self.open.exists() else None
        path = [list(p) for p in self.run.get()] if state and state[5] else []
        # n is 0 once the run has been sent.
        segment, start, last, x, y, n = state or (0, None, None, None, None, 0)

        def close() -> None:
            if n > 1:
                lines.append((key[0], "move", segment, n, start, last, "", path))

        for t, _, lon, lat in ready:
            if last is not None and t - last > self.gap:
                close()
                minutes = (t - last) // 60
                label = f"+{minutes // 60}h {minutes % 60:02d}m" if t - last >= self.label else ""
                segment += 1
                lines.append((key[0], "gap", segment, 2, last, t, label, [[x, y], [lon, lat]]))
                start, n, path = t, 0, []
            elif last is None:
                start = t
            last, x, y, n = t, lon, lat, n + 1
            path.append([lon, lat])
        if last is not None and n:
            if passed >= last + self.gap:
                close()
                n, path = 0, []
            else:
                self.handle.registerTimer((last + self.gap) * 1000 + 1)
        if last is not None:
            self.open.update((segment, start, last, x, y, n))
            if path:
                self.run.put([tuple(p) for p in path])
            else:
                self.run.clear()
        if lines:
            yield pd.DataFrame(lines, columns=[c.split()[0] for c in LINE.split(", ")])


def speed_outliers(stream: DataFrame, late: str | None = None, **limits) -> DataFrame:
    """maid, seq, timestamp, is_outlier of a stream(maid, seq, timestamp, longitude, latitude). Needs the RocksDB state store provider.

    late: None flags pings as they come (see LastPing); else they are held back for so long and flagged in order, as the batch form
    does, and later ones are left out; the stream then needs its event time in a column `at`. Pings without a time are never outliers
    and are passed on as they come, past the state.
    """
    schema = "maid string, seq long, timestamp long, is_outlier boolean"
    timed, untimed = stream.filter("timestamp IS NOT NULL"), stream.filter("timestamp IS NULL")
    if late is None:
        flagged = timed.groupBy("maid").transformWithStateInPandas(LastPing(**limits), schema, "append", "none")
    else:
        flagged = timed.withWatermark("at", late).groupBy("maid").transformWithStateInPandas(Speeds(**limits), schema, "append", "EventTime")
    return flagged.unionByName(untimed.select("maid", "seq", "timestamp", F.lit(False).alias("is_outlier")))


def line_segments(stream: DataFrame, late: str = "1 hour", gap_min: float = 30, label_min: float = 60) -> DataFrame:
    """Move and gap lines of a stream(maid, seq, timestamp, longitude, latitude, at timestamp), as the batch form gives them.

    A move is sent once the watermark shows that no ping can join it, a gap with the ping that ends it. Pings later than `late` and
    pings without a time are left out. Needs the RocksDB state store provider.
    """
    rows = stream.filter("timestamp IS NOT NULL").select("maid", "seq", "timestamp", "at", *(F.bround(c, 6).alias(c) for c in ("longitude", "latitude")))
    return rows.withWatermark("at", late).groupBy("maid").transformWithStateInPandas(Gaps(gap_min, label_min), LINE, "append", "EventTime")


def ingest(spark, raw: str, out: str, checkpoint: str):
    """Appends CSV files that are new since the last run to Parquet, and stops when none is left. Rows are those of the batch reader."""
    rows = typed_pings(spark.readStream.schema(RAW_PING).option("header", True).option("mode", "PERMISSIVE").csv(raw))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
