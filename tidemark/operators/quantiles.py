"""Exact quantiles of groups of any size.

A mergeable sketch brackets each quantile. While a bracket holds more rows than a bound (and more than one
value), a pass over those rows narrows it. A last pass counts the rows between the brackets and keeps only
the values inside them. The ranks of those values are then exact, and what is ordered per group is at
most ``bound`` rows for each quantile, or ``accuracy`` rows of a small group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Sequence[float],
    accuracy: int = 10000,
    bound: int = 1_000_000,
    also: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """``keys``, ``n`` and ``q`` (array, one entry per q): linear interpolation between order
    statistics, nulls left out. Runs the sketch at once; the rest is lazy. ``also``: other aggregates of the value, by name, which
    the sketch's pass takes along."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin = 3.0 / accuracy
    edges = [min(max(q + side * margin, 0.0), 1.0) for q in qs for side in (-1, 1)]
    cuts = F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(accuracy))
    # Written first, so that its size is known: few groups are broadcast, many join by shuffle.
    extra = [make(F.col("_v")).alias(name) for name, make in (also or {}).items()]
    taken = cut(rows.groupBy(*keys).agg(F.count("_v").alias("n"), cuts.alias("_cuts"), *extra), "sketch")
    sketch = _narrowed(rows, taken.select(*keys, "n", "_cuts"), keys, qs, accuracy, bound)
    lows = [F.get("_cuts", F.lit(2 * i)) for i in range(len(qs))]
    highs = [F.get("_cuts", F.lit(2 * i + 1)) for i in range(len(qs))]
    v = F.col("_v")
    # The brackets hold a few spare ranks once n exceeds the accuracy; smaller groups are ranked whole.
    inside = F.col("n") <= accuracy
    for low, high in zip(lows, highs):
        inside = inside | ((v >= low) & (v <= high))
    band = sum(((v > edge).cast("int") for edge in [*lows, *highs]), F.lit(0))
    joined = rows.join(sketch, keys)
    counted = joined.groupBy(*keys, "n", band.alias("_band"), F.when(inside, v).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    order = Window.partitionBy(*keys).orderBy("_band", F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_to") > rank, F.col("_v")))

    def interpolated(q: float) -> Column:
        where = F.lit(float(q)) * (F.col("n") - 1)
        low, high = at(F.floor(where)), at(F.ceil(where))
        return low + (high - low) * F.max(where - F.floor(where))

    found = ranked.groupBy(*keys, "n").agg(F.array(*[interpolated(q) for q in qs]).alias("q"))
    return found.join(taken.select(*keys, *also), keys) if also else found


#: Steps that a bracket is cut into when it is narrowed.
_STEPS = 100


def _narrowed(
    rows: DataFrame, sketch: DataFrame, keys: list[str], qs: Sequence[float], accuracy: int, bound: int
) -> DataFrame:
    """The sketch with brackets of at most ``bound`` rows, or of one value. Each pass merges map-side; the driver
    sees one row a pass."""
    v, bound, before = F.col("_v"), max(bound, 10 * _STEPS), None
    if (sketch.agg(F.max("n")).first()[0] or 0) <= max(accuracy, bound):
        return sketch
    while True:
        joined = rows.join(sketch.where(F.col("n") > max(accuracy, bound)), keys)
        counts = []
        for i in range(len(qs)):
            low, high = F.get("_cuts", F.lit(2 * i)), F.get("_cuts", F.lit(2 * i + 1))
            inside = (v >= low) & (v <= high)
            steps = F.percentile_approx(F.when(inside, v), F.array(*[F.lit(k / _STEPS) for k in range(_STEPS + 1)]), F.lit(max(accuracy, 10 * _STEPS)))
            counts += [F.count_if(v < low).alias(f"_below{i}"), F.count_if(inside).alias(f"_in{i}"), steps.alias(f"_steps{i}")]
        wide = F.greatest(*(_wide(i) for i in range(len(qs))), F.lit(0))
        found = cut(joined.groupBy(*keys, "n", "_cuts").agg(*counts).withColumn("_wide", wide), "brackets")
        widest, total = found.agg(F.max("_wide"), F.sum("_wide")).first()
        # A bracket that stays as wide holds many copies of a value, which are counted, not ordered.
        if (widest or 0) <= bound or total == before:
            return sketch
        before = total
        cuts = []
        for i, q in enumerate(qs):
            place = F.floor((F.lit(float(q)) * (F.col("n") - 1) - F.col(f"_below{i}")) / F.col(f"_in{i}") * _STEPS).cast("int")
            narrow = [F.get(f"_steps{i}", F.greatest(place - 1, F.lit(0))), F.get(f"_steps{i}", F.least(place + 2, F.lit(_STEPS)))]
            cuts += [F.when(_wide(i) > bound, edge).otherwise(F.get("_cuts", F.lit(2 * i + k))) for k, edge in enumerate(narrow)]
        fresh = found.select(*keys, F.array(*cuts).alias("_fresh"))
        sketch = cut(sketch.join(fresh, keys, "left").select(*keys, "n", F.coalesce("_fresh", "_cuts").alias("_cuts")), "sketch")


def _wide(i: int) -> Column:
    """Rows of a bracket that can still be narrowed."""
    return F.when(F.get("_cuts", F.lit(2 * i)) < F.get("_cuts", F.lit(2 * i + 1)), F.col(f"_in{i}")).otherwise(F.lit(0))
