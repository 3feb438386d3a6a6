"""Exact quantiles by narrowing brackets, with bounded tasks whatever the number of distinct values.

Each round reads the rows twice and moves only aggregates of fixed size: a sketch proposes values just below and above the wanted rank,
then exact counts of rows below, at and between them decide. Either one of the two is the value, or the rank lies strictly between,
and a round leaves a few ten-thousandths of the rows. Once no more than `most` rows lie between, their values are counted and read off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a sketch; its ranks are wrong by at most one in this many rows.
ACCURACY = 10_000
MOST = 20_000


@dataclass
class _Target:
    """The value of a rank (from 0) of a column: strictly between low and high, `below` rows lie at or under low, `inside` between."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None
    pair: tuple[float, float] | None = field(default=None, repr=False)

    def within(self) -> Column:
        c = F.col(self.column)
        known = c.isNotNull() & ~F.isnan(c)
        for bound, test in ((self.low, c > F.lit(self.low)), (self.high, c < F.lit(self.high))):
            known = known & test if bound is not None else known
        return known


def _narrow(rows: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """One round for all targets: a job for the sketches, a job for the counts."""
    asked = []
    for t in targets:
        slack = 2 * t.inside / accuracy + 1
        shares = [min(1.0, max(0.0, (t.rank - t.below + d * slack) / max(1, t.inside - 1))) for d in (-1, 1)]
        asked.append(F.approx_percentile(F.when(t.within(), F.col(t.column)), F.array(*map(F.lit, shares)), F.lit(accuracy)))
    for t, pair in zip(targets, rows.agg(*(c.alias(f"p{k}") for k, c in enumerate(asked))).first(), strict=True):
        t.pair = tuple(pair)
    counts = []
    for k, t in enumerate(targets):
        c = F.when(t.within(), F.col(t.column))
        counts += [F.count_if(test).alias(f"c{k}_{j}") for j, test in enumerate((c < t.pair[0], c <= t.pair[0], c < t.pair[1], c <= t.pair[1]))]
    found = rows.agg(*counts).first()
    for k, t in enumerate(targets):
        under_a, to_a, under_b, to_b = (t.below + found[4 * k + j] for j in range(4))
        a, b = t.pair
        if under_a <= t.rank < to_a:
            t.value = a
        elif under_b <= t.rank < to_b:
            t.value = b
        elif t.rank < under_a:
            t.high, t.inside = a, under_a - t.below
        elif t.rank >= to_b:
            t.low, t.inside, t.below = b, t.inside - (to_b - t.below), to_b
        else:
            t.low, t.high, t.inside, t.below = a, b, under_b - to_a, to_a


def _read_off(rows: DataFrame, t: _Target) -> None:
    at = t.below
    for value, n in rows.filter(t.within()).groupBy(F.col(t.column).alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect():  # at most `most` rows
        at += n
        if t.rank < at:
            t.value = value
            return
    raise ValueError(f"the rows of {t.column} changed while they were read")


def exact_quantiles(df: DataFrame, columns: list[str], shares=(0.5,), most: int = MOST, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """column -> its quantiles, interpolated between the two nearest ranks; None without values. Nulls are left out; NaN is the largest.

    df is read a few times: persist it, or pass a table.
    """
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    sizes = rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("nan", lambda c: F.count_if(F.isnan(F.col(c))))))).first()
    wanted: dict[tuple[str, int], _Target] = {}
    places: dict[str, list[tuple[int, int, float]]] = {}
    for c in columns:
        n, nan = sizes[f"n_{c}"], sizes[f"nan_{c}"]
        for share in shares:
            at = share * (n - 1)
            low, high = math.floor(at), math.ceil(at)
            places.setdefault(c, []).append((low, high, at - low))
            for rank in {low, high} if n else ():
                wanted.setdefault((c, rank), _Target(c, rank, n - nan, value=math.nan if rank >= n - nan else None))
    while todo := [t for t in wanted.values() if t.value is None and t.inside > most]:
        _narrow(rows, todo, accuracy)
    for t in wanted.values():
        if t.value is None:
            _read_off(rows, t)

    def between(c: str, low: int, high: int, part: float) -> float | None:
        if not sizes[f"n_{c}"]:
            return None
        a, b = wanted[c, low].value, wanted[c, high].value
        return a if low == high else (1 - part) * a + part * b

    return {c: [between(c, *p) for p in places[c]] for c in columns}
