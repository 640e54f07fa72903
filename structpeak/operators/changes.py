"""Penalised change points of daily levels, and rule weights learned from votes without labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structpeak.config import SERIES_KEY

SMALLEST_SHARE = 1e-6
# Levels of series cut at once.
CELLS = 100_000


def _best_starts(sums: np.ndarray, squares: np.ndarray, charge: np.ndarray) -> np.ndarray:
    """For every series (row) and end 1..n, where the last segment of the cheapest cut up to there begins.

    A dynamic programme over the ends, all series of a batch at once. Ties go to the earliest start.
    """
    rows, n = sums.shape[0], sums.shape[1] - 1
    cost, back = np.empty((rows, n + 1)), np.zeros((rows, n + 1), np.int64)
    cost[:, 0] = -charge
    for end in range(1, n + 1):
        total = sums[:, end, None] - sums[:, :end]
        trials = cost[:, :end] + (squares[:, end, None] - squares[:, :end] - total * total / (end - np.arange(end))) + charge[:, None]
        best = back[:, end] = trials.argmin(axis=1)
        cost[:, end] = trials[np.arange(rows), best]
    return back


def _cheapest_cuts(penalty: float, keys: Sequence[str]):
    """Task function: series as arrays of days and levels to one row a segment."""

    def cut(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Series, border before and border after of all segments of series of one length, and the running sums."""
        rows, n = levels.shape
        sums, squares = (np.concatenate((np.zeros((rows, 1)), np.cumsum(x, axis=1)), axis=1) for x in (levels, levels * levels))
        back = _best_starts(sums, squares, penalty * levels.var(axis=1) * np.log(n))
        edge = np.zeros((rows, n + 1), bool)  # borders of the cheapest cut
        at, every = np.full(rows, n), np.arange(rows)
        while at.any():
            edge[every, at] = True
            at = back[every, at]
        edge[:, 0] = True
        row, place = np.nonzero(edge)
        inside = row[1:] == row[:-1]
        return row[:-1][inside], place[:-1][inside], place[1:][inside], sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed = batch.column("_days")
            first, size = np.asarray(packed.offsets)[:-1].astype(np.int64), np.diff(np.asarray(packed.offsets))
            days = packed.values.field("day")
            levels = packed.values.field("day_median").to_numpy(zero_copy_only=False)
            parts = []
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                for some in np.array_split(own, max(1, len(own) * int(n) // CELLS)):
                    row, lo, hi, sums = cut(levels[first[some, None] + np.arange(n)])
                    parts.append(np.stack((some[row], lo, hi, ((sums[row, hi] - sums[row, lo]) / (hi - lo)).view(np.int64))))
            of, lo, hi, level = np.concatenate(parts, axis=1)
            order = np.lexsort((lo, of))
            of, lo, hi, level = of[order], lo[order], hi[order], level[order].view(np.float64)
            number = np.arange(len(of)) - np.searchsorted(of, of)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(pa.array(of)) for k in keys], pa.array(number), days.take(pa.array(first[of] + lo)), days.take(pa.array(first[of] + hi - 1)), pa.array(hi - lo), pa.array(level)],
                [*keys, "segment", "first_day", "last_day", "n_days", "segment_level"])

    return run


def change_points(days: DataFrame, penalty: float = 3.0, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Segments of constant level of each series: the cut of least squared error plus a penalty a segment.

    ``days`` has at most one row a day (``day, day_median``), so a series is one array of at most 366 values. The
    penalty is ``penalty`` times the variance of the daily levels times the logarithm of their number. One row a segment: number from 0, first and last day, days, mean level.
    """
    keys = list(keys)
    packed = F.array_sort(F.collect_list(F.struct("day", "day_median")))
    series = days.where(F.col("day_median").isNotNull()).groupBy(*keys).agg(packed.alias("_days"))
    schema = ", ".join(f"`{k}` {days.schema[k].dataType.simpleString()}" for k in keys)
    day = days.schema["day"].dataType.simpleString()
    return series.mapInArrow(
        _cheapest_cuts(float(penalty), keys), f"{schema}, segment bigint, first_day {day}, last_day {day}, n_days bigint, segment_level double")


@dataclass(frozen=True)
class RuleModel:
    """Share of manoeuvres, and how often each rule votes for one when it is one and when it isn't."""

    votes: tuple[str, ...]
    prior: float
    if_true: tuple[float, ...]
    if_false: tuple[float, ...]

    def probability(self) -> Column:
        """Probability of a manoeuvre given the row's votes; an unknown vote says nothing."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for name, a, b in zip(self.votes, self.if_true, self.if_false, strict=True):
            says = F.when(F.col(name), F.lit(float(np.log(a / b)))).otherwise(F.lit(float(np.log((1 - a) / (1 - b)))))
            odds = odds + F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(says)
        return 1 / (1 + F.exp(-odds))


def learn_rules(rows: DataFrame, votes: Sequence[str], rounds: int = 10) -> RuleModel:
    """Rule accuracies by expectation-maximisation over the counts of vote patterns.

    Rules are taken to err independently. The data are reduced to one count a pattern (two to the number of rules), whatever
    their size; the rounds run on those. The first guess of a pattern is its share of votes. Rows with an unknown vote are left out.
    """
    votes = tuple(votes)
    known = reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in votes])
    counts = rows.where(known).groupBy(*votes).agg(F.count("*").alias("_n")).collect()
    if not counts:
        raise ValueError("no row with known votes")
    v = np.array([[float(r[name]) for name in votes] for r in counts])
    n = np.array([float(r["_n"]) for r in counts])
    clipped = lambda x: np.clip(x, SMALLEST_SHARE, 1 - SMALLEST_SHARE)
    q = v.mean(axis=1)
    for _ in range(rounds):
        prior = clipped((n * q).sum() / n.sum())
        a, b = (clipped(w @ v / max(w.sum(), SMALLEST_SHARE)) for w in (n * q, n * (1 - q)))
        yes, no = prior * np.prod(np.where(v > 0, a, 1 - a), axis=1), (1 - prior) * np.prod(np.where(v > 0, b, 1 - b), axis=1)
        q = yes / (yes + no)
    return RuleModel(votes, float(prior), tuple(map(float, a)), tuple(map(float, b)))
