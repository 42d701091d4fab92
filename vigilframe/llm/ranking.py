"""One ranking from several scores on different scales.

Scores are winsorised at two quantiles, divided by the length of their column, and each record is
placed by its relative closeness to the ideal point (the best value of every score) as against the
anti-ideal point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.ordering import number_rows


@dataclass(frozen=True)
class Score:
    """A score column: its bounds (values beyond them count as missing) and its weight."""

    name: str
    low: float = 0.0
    high: float = 1.0
    weight: float = 1.0


#: Bins into which a range of values is divided in one pass; order statistics are exact all the same.
BINS = 4096
#: Squares are summed in whole parts of this, so that the sum doesn't depend on its order.
SQUARE_PART = 1e12


def _scaled(s: Score) -> Column:
    """A score as its place between its bounds (0 to 1), null where it is missing."""
    x = F.col(s.name).cast("double")
    sound = x.isNotNull() & ~F.isnan(x) & (x >= s.low) & (x <= s.high)
    return F.when(sound, (x - F.lit(s.low)) / F.lit(s.high - s.low))


def order_statistics(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """The exact values at the given shares of each column's sound (not null) values from 0 to 1, of rank ceil(share x n).

    Each pass counts values in BINS bins, where the rows are, and goes on within the bin that holds the rank, until that
    holds a single value: the bins that come to the driver are at most BINS for each column and share.
    Values are told apart to the last digit.  A column without values gives nulls.
    """
    found: dict[tuple[str, float], float | None] = {}
    # (column, low, high) -> shares sought there, and how many values lie below low
    open_ = {(c, 0.0, 1.0): ([*shares], 0) for c in columns}
    total: dict[str, int] = {}
    while open_:
        spans = list(open_)

        def place(k: int) -> Column:
            c, low, high = spans[k]
            v = F.col(c)
            at = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS))), F.lit(BINS - 1)) if high > low else F.lit(0)
            return F.when(v.between(low, high), F.struct(F.lit(k).alias("k"), at.cast("int").alias("b"), v.alias("v")))

        stacked = df.select(F.explode(F.array_compact(F.array(*(place(k) for k in range(len(spans)))))).alias("e"))
        bins = stacked.groupBy("e.k", "e.b").agg(F.count("*").alias("n"), F.min("e.v").alias("low"), F.max("e.v").alias("high")).collect()
        following: dict[tuple[str, float, float], tuple[list[float], int]] = {}
        for k, span in enumerate(spans):
            c = span[0]
            sought, below = open_[span]
            own = sorted((r.b, r.n, r.low, r.high) for r in bins if r.k == k)
            total.setdefault(c, sum(n for _, n, _, _ in own))
            for p in sought:
                need, so_far = max(1, math.ceil(p * total[c])), below
                found[c, p] = None
                for _, n, low, high in own:
                    if so_far + n >= need:
                        if low == high:
                            found[c, p] = low
                        else:
                            following.setdefault((c, low, high), ([], so_far))[0].append(p)
                        break
                    so_far += n
        open_ = following
    return {c: [found[c, p] for p in shares] for c in columns}


def score_statistics(scaled: DataFrame, scores: list[Score], tail: float) -> list[dict[str, float]]:
    """Per score: the winsor bounds, the median and the column's length, over all rows.

    The first three are exact; the length is that of the winsorised column with gaps filled, its squares
    rounded to 1 / SQUARE_PART each.
    """
    names = [f"_s{k}" for k in range(len(scores))]
    at = order_statistics(scaled, names, [tail, 0.5, 1 - tail])
    bounds = [dict(zip(("low", "middle", "high"), (x or 0.0 for x in at[c]))) for c in names]
    squares = scaled.agg(*(F.sum(F.round(_within(c, b) * _within(c, b) * F.lit(SQUARE_PART)).cast("decimal(18,0)")).alias(c) for c, b in zip(names, bounds))).first()
    return [b | {"length": math.sqrt(int(squares[c] or 0) / SQUARE_PART) or 1.0} for c, b in zip(names, bounds)]


def _within(column: str, b: dict[str, float]) -> Column:
    return F.least(F.greatest(F.coalesce(F.col(column), F.lit(b["middle"])), F.lit(b["low"])), F.lit(b["high"]))


def ideal_point_ranking(df: DataFrame, id_col: str, scores: list[Score], tail: float = 0.01) -> DataFrame:
    """(id, scores_known, closeness, rank): all rows in one order, rank 1 the best.

    closeness = d- / (d+ + d-), with the weighted distances to the ideal and the anti-ideal point; it is shown to
    nine decimals, but rows are ranked by its full value.  Equal ones follow the id (a null id last), so ranks are
    distinct.  A score that is null, NaN or out of its bounds counts as the median of its column, so that a gap
    neither lifts nor sinks a record.  A score without any sound value has no influence; if none has, closeness is
    0.5 everywhere.  Repeated rows are ranked each.  An empty table gives an empty ranking.  Other columns aren't read.
    """
    scaled = df.select(F.col(id_col), *(_scaled(s).alias(f"_s{k}") for k, s in enumerate(scores)))
    best, worst = F.lit(0.0), F.lit(0.0)
    for k, (s, x) in enumerate(zip(scores, score_statistics(scaled, scores, tail))):
        v = _within(f"_s{k}", x)
        off = lambda end: (v - F.lit(x[end])) / F.lit(x["length"]) * F.lit(s.weight)  # noqa: B023, E731
        best, worst = best + off("high") * off("high"), worst + off("low") * off("low")
    near, far = F.sqrt(best), F.sqrt(worst)
    closeness = F.when(near + far > 0, far / (near + far)).otherwise(F.lit(0.5))
    known = sum((F.col(f"_s{k}").isNotNull().cast("int") for k in range(len(scores))), F.lit(0))
    placed = scaled.select(id_col, known.alias("scores_known"), closeness.alias("_c"))
    ranked = number_rows(placed, [F.desc("_c"), F.asc_nulls_last(id_col)], "rank")
    return ranked.select(id_col, "scores_known", F.round("_c", 9).alias("closeness"), "rank")
