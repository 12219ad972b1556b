"""Reports over labels, predictions, returns and features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import month_start, ratio
from tidemark.operators.joins import offset_lookup
from tidemark.operators.panel import Panel, Rolling, Running
from tidemark.operators.quantiles import exact_quantiles


def frequency(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and percent of each value."""
    keys = list(keys)
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    # One row per distinct value is left here.
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", 100.0 * F.col("n") / total)


def topk_coverage(df: DataFrame, column: str, k: int = 2, percent: float = 80.0) -> DataFrame:
    """Share of the ``k`` most frequent values (name breaks ties) and whether it reaches ``percent``."""
    counted = frequency(df, column).orderBy(F.desc("n"), column).limit(k)
    covered = F.sum("percent")
    return counted.agg(
        F.sort_array(F.collect_list(column)).alias("top"),
        covered.alias("covered"),
        (F.round(covered, 9) >= percent).cast("int").alias("enough"),
    )


def monthly_mode(labels: DataFrame, column: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Most frequent label of each month; ties go to the label seen first, then by name."""
    keys = list(keys)
    counts = labels.groupBy(*keys, month_start(F.col("ts")).alias("month"), column).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("_seen")
    )
    rank = F.struct((-F.col("n")).alias("a"), F.col("_seen").alias("b"), F.col(column).alias("c"))
    return counts.groupBy(*keys, "month").agg(F.min_by(column, rank).alias(column), F.max("n").alias("n"))


def transitions(monthly: DataFrame, column: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of moves from last month's label to this month's, per previous label (long form)."""
    w = Window.partitionBy(*keys).orderBy("month")
    moves = monthly.withColumn("previous", F.lag(column, 1).over(w)).where(F.col("previous").isNotNull())
    counts = moves.groupBy("previous", F.col(column).alias("current")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("previous")))


def transition_matrix(monthly: DataFrame, column: str, labels: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The same as a matrix: one row per previous label, one column per current label."""
    return (
        transitions(monthly, column, keys).groupBy("previous").pivot("current", list(labels)).agg(F.first("share")).fillna(0.0)
    )


def pivot_metrics(metrics: DataFrame, rows: Sequence[str], strategies: Sequence[str], value: str) -> DataFrame:
    return metrics.groupBy(*rows).pivot("strategy", list(strategies)).agg(F.first(value))


def monthly_counts(df: DataFrame, column: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows per month and value, one column per value."""
    grouped = df.groupBy(*keys, month_start(F.col("ts")).alias("month"))
    return grouped.pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def describe_by(df: DataFrame, key: str, columns: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, std, min, quantiles and max of each column per value of ``key``. A key may
    hold any share of the rows: everything merges map-side, quantiles are bracketed first."""
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(key, *numbers).unpivot([key], list(columns), "feature", "value")
    ids = [key, "feature"]
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = exact_quantiles(long, ids, "value", percentiles, also=moments)
    shown = [F.get("q", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(percentiles)]
    return found.select(*ids, "n", "mean", "std", "min", *shown, "max")


def profile(df: DataFrame, columns: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The same for a whole table, with the number of nulls."""
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    long = df.select(*numbers).unpivot([], list(columns), "feature", "value")
    nulls = long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("nulls"))
    described = describe_by(df.withColumn("_all", F.lit(0)), "_all", columns, percentiles)
    return described.drop("_all").join(nulls, "feature")


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """Date range and size of two tables and the size of their overlap, in one row."""
    marked = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    # Per key the rows of either side; an inner join would give their product.
    per_key = marked.groupBy(*keys).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))

    def edge(side: str, how) -> Column:
        return how(F.when(F.col(side) > 0, F.col("ts")))

    return per_key.agg(
        edge("_a", F.min).alias("a_first"),
        edge("_a", F.max).alias("a_last"),
        F.sum("_a").alias("a_rows"),
        edge("_b", F.min).alias("b_first"),
        edge("_b", F.max).alias("b_last"),
        F.sum("_b").alias("b_rows"),
        F.sum(F.col("_a") * F.col("_b")).alias("overlap"),
    )


def crossover_events(panel: Panel, first: str, second: str) -> Panel:
    """Rows where the lead between two summed returns changes hands. An unknown or zero
    difference counts as the second leading; the first row is never an event."""
    panel = panel.scan({"_a": Running("sum", F.col(first)), "_b": Running("sum", F.col(second))})
    lead = F.when(F.col("_a") - F.col("_b") > 0, 1).otherwise(-1)
    panel = panel.with_columns({"diff": F.col("_a") - F.col("_b"), "lead": lead})
    panel = panel.roll({"_was": Rolling(lambda w: F.lag("lead", 1).over(w), back=1)})
    event = F.coalesce((F.col("_was") != F.col("lead")).cast("int"), F.lit(0))
    return panel.with_df(panel.df.withColumn("event", event).drop("_a", "_b", "_was"))


def event_profile(events: DataFrame, features: DataFrame, columns: Sequence[str], days: int = 5) -> DataFrame:
    """Mean of each feature ``days`` before and after the events, and the change."""
    found = offset_lookup(events.select("symbol", "ts"), features.select("symbol", "ts", *columns), days, columns)
    means = found.agg(*[F.avg(f"{side}_{c}").alias(f"{side}_{c}") for side in ("pre", "post") for c in columns])
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"pre_{c}").alias("pre_avg"),
            F.col(f"post_{c}").alias("post_avg"),
            (F.col(f"post_{c}") - F.col(f"pre_{c}")).alias("change"),
        )
        for c in columns
    ]
    return means.select(F.inline(F.array(*rows)))


def forward_by_strategy(chosen: DataFrame, strategy: str, forward: str) -> DataFrame:
    return (
        chosen.groupBy(strategy).agg(F.avg(forward).alias("mean_forward"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("mean_forward"), strategy)
    )


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations, long form, every pair in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            rows.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr")))
    return one.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max, the last edge included."""
    rows = df.select(F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    # Both edges come as one value, so the input is read twice: for them, and to count.
    edges = rows.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    placed = rows.select("_x", edges.alias("_edges"))
    placed = placed.select("_x", F.col("_edges.lo").alias("lo"), ((F.col("_edges.hi") - F.col("_edges.lo")) / bins).alias("width"))
    bin_of = F.least(F.floor(ratio(F.col("_x") - F.col("lo"), F.col("width"))), F.lit(bins - 1))
    counted = placed.groupBy(F.coalesce(bin_of, F.lit(0)).cast("int").alias("bin"), "lo", "width").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("left"), "n")


def volume_allocation(panel: Panel, shares: float = 100.0, volume: str = "volume") -> Panel:
    """Order split over bars by their share of the volume."""
    panel = panel.totals({"_total": F.sum(F.col(volume).cast("double"))})
    order = ratio(F.col(volume).cast("double"), F.col("_total")) * shares
    return panel.with_df(panel.df.withColumn("order", order).drop("_total"))


_SCREENED = ("rsi", "cci", "adx", "di_pos")


@dataclass(frozen=True)
class Entry:
    """The levels of the entry conditions. The defaults are those of the reported screen."""

    rsi: float = 60.0
    cci: float = 100.0
    strength: float = 25.0
    price: float = 100.0


def entry_condition(at: Entry = Entry()) -> Column:
    """The entry conditions of one bar, given its screen indicators and the previous bar's."""
    c = F.col
    return (
        (c("close") > c("ema_high"))
        & (c("rsi") > at.rsi)
        & (c("prev_rsi") < at.rsi)
        & (c("cci") < at.cci)
        & (c("prev_cci") < at.cci)
        & (c("adx") > at.strength)
        & (c("di_pos") > at.strength)
        & (c("prev_di_pos") < c("prev_adx"))
        & (c("di_pos") > c("adx"))
        & (c("open") >= at.price)
    )


def with_previous(panel: Panel) -> Panel:
    return panel.roll({f"prev_{c}": Rolling(lambda w, c=c: F.lag(c, 1).over(w), back=1) for c in _SCREENED})


def screen_bars(panel: Panel, at: Entry = Entry()) -> Panel:
    """All bars that meet the entry conditions as of their own date; needs the screen's indicators."""
    return with_previous(panel).where(entry_condition(at))


def screen(panel: Panel, at: Entry = Entry()) -> DataFrame:
    """Series whose latest bar meets the entry conditions."""
    columns = ("ts", "open", "close", "ema_high", *_SCREENED, *[f"prev_{c}" for c in _SCREENED])
    return with_previous(panel).last_rows(*columns).where(entry_condition(at))
