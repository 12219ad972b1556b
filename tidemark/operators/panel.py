"""Ordered work on a panel of bars, with no task ever holding an unbounded series.

A series (one value of ``keys``) has at most one bar per calendar slot, so its length is bounded
by the calendar. ``arrange`` looks at that bound:

* the whole calendar fits in ``rows`` slots: every series is one window group;
* otherwise each series is cut into segments of ``rows`` bars. Rolling frames get the rows they
  reach for from the neighbouring segment (``roll``), running values get a carry from the segment
  summaries (``scan``). A series that holds a third of all bars is then many groups, and only its
  summaries, one row per ``rows`` bars, are ordered together.

Both layouts give the same values; the tests run every operator on both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "_pos"
SEG = "_seg"
_CORE = "_core"
SEGMENT_ROWS = 4096
GRAIN_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}

# Powers up to exp(600) leave room for sums of any price below the largest double, exp(709).
_LARGEST_LOG = 600.0


@dataclass(frozen=True)
class Rolling:
    """A column computed from at most ``back`` rows before and ``ahead`` rows after."""

    build: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 0


@dataclass(frozen=True)
class Affine:
    """y[t] = coef * y[t-1] + drive[t], y before the first row being 0."""

    coef: float
    drive: Column


@dataclass(frozen=True)
class Running:
    """Running sum, product, max or min. Null inputs are skipped and stay null."""

    kind: str
    value: Column


Scan = Affine | Running

_RUNNING = {"sum": F.sum, "prod": F.product, "max": F.max, "min": F.min}


def _combine(kind: str, left: Column, right: Column) -> Column:
    if kind == "sum":
        return F.coalesce(left, F.lit(0.0)) + right
    if kind == "prod":
        return F.coalesce(left, F.lit(1.0)) * right
    return F.greatest(left, right) if kind == "max" else F.least(left, right)


def slot_number(df: DataFrame, order: str, grain: str | int) -> Column:
    """Calendar slot of a bar, counted from 1970."""
    seconds = GRAIN_SECONDS[grain] if isinstance(grain, str) else int(grain)
    if isinstance(df.schema[order].dataType, T.DateType):
        return F.floor(F.unix_date(order).cast("long") * 86400 / seconds)
    return F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / seconds)


def calendar_slots(df: DataFrame, order: str = "ts", grain: str | int = "day") -> int:
    """Number of calendar slots ``df`` spans: no series can have more bars. Reads one column."""
    slot = slot_number(df, order, grain)
    low, high = df.agg(F.min(slot), F.max(slot)).first()
    return 0 if low is None else int(high - low) + 1


@dataclass(frozen=True)
class Panel:
    df: DataFrame
    keys: tuple[str, ...]
    order: str
    rows: int  # bars per segment
    segments: int  # bound on the segments of a series; 1 when a series is one group

    @property
    def blocked(self) -> bool:
        return self.segments > 1

    @property
    def group(self) -> list[str]:
        """Columns of one window group."""
        return [*self.keys, SEG] if self.blocked else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.order)

    def with_df(self, df: DataFrame) -> Panel:
        return replace(self, df=df)

    def with_columns(self, columns: Mapping[str, Column]) -> Panel:
        return self.with_df(self.df.withColumns(dict(columns)))

    def where(self, condition: Column) -> Panel:
        """Keep some rows. Before a further ``roll`` drop only rows at the ends of a series."""
        return self.with_df(self.df.where(condition))

    def select(self, *columns: str | Column) -> DataFrame:
        return self.df.select(*columns)

    def table(self) -> DataFrame:
        return self.df.drop(POS, SEG)

    # ------------------------------------------------------------------ rolling frames

    def roll(self, *layers: Mapping[str, Rolling | Column]) -> Panel:
        """Add rolling columns; a later layer may use the columns of an earlier one."""
        back = sum(max((_reach(r, "back") for r in layer.values()), default=0) for layer in layers)
        ahead = sum(max((_reach(r, "ahead") for r in layer.values()), default=0) for layer in layers)
        widen = self.blocked and (back or ahead)
        df = self._with_halo(back, ahead) if widen else self.df
        w = self.window()
        for layer in layers:
            df = df.withColumns(
                {n: r.build(w) if isinstance(r, Rolling) else r for n, r in layer.items()}
            )
        if widen:
            df = df.where(_CORE).drop(_CORE)
        return self.with_df(df)

    def _with_halo(self, back: int, ahead: int) -> DataFrame:
        """Copy each row into the segments whose frames reach it, several of them for a long frame."""
        place = F.col(POS) % self.rows
        homes = [F.struct(F.col(SEG).alias(SEG), F.lit(True).alias(_CORE))]
        for step in range(1, -(-back // self.rows) + 1):
            later = F.struct((F.col(SEG) + step).alias(SEG), F.lit(False).alias(_CORE))
            homes.append(F.when(place >= step * self.rows - back, later))
        for step in range(1, -(-ahead // self.rows) + 1):
            earlier = F.struct((F.col(SEG) - step).alias(SEG), F.lit(False).alias(_CORE))
            homes.append(F.when((place < ahead - (step - 1) * self.rows) & (F.col(SEG) >= step), earlier))
        rest = [F.col(f"`{c}`") for c in self.df.columns if c != SEG]
        return self.df.select(*rest, F.inline(F.array_compact(F.array(*homes))))

    # ------------------------------------------------------------------ running values

    def scan(self, specs: Mapping[str, Scan]) -> Panel:
        """Add running columns, all from one pass per segment and one carry join."""
        df = self.df
        w = self.window()
        place = F.col(POS) % self.rows if self.blocked else F.col(POS)
        scaled = {n for n, s in specs.items() if isinstance(s, Affine) and _fits(s.coef, self.rows)}
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        inputs, local = {}, {}
        for n, s in specs.items():
            if isinstance(s, Running):
                inputs[f"_in_{n}"], local[f"_loc_{n}"] = s.value, _RUNNING[s.kind](f"_in_{n}").over(running)
            elif n in scaled:
                inputs[f"_in_{n}"] = s.drive * F.pow(F.lit(s.coef), -place)
                local[f"_loc_{n}"] = F.sum(f"_in_{n}").over(running) * F.pow(F.lit(s.coef), place)
            else:
                local[f"_loc_{n}"] = s.drive
        df = (df.withColumns(inputs) if inputs else df).withColumns(local)
        df = _doubling(df, {f"_loc_{n}": s for n, s in specs.items() if n not in scaled}, w, self.rows, 1)
        if self.blocked:
            df = df.join(self._carries(df, specs), self.group, "left")
        out: dict[str, Column] = {}
        for n, s in specs.items():
            value, carry = F.col(f"_loc_{n}"), F.col(f"_carry_{n}") if self.blocked else None
            if isinstance(s, Affine):
                out[n] = value if carry is None else value + F.pow(F.lit(s.coef), place + 1) * F.coalesce(carry, F.lit(0.0))
            else:
                whole = value if carry is None else _combine(s.kind, carry, value)
                out[n] = F.when(F.col(f"_in_{n}").isNotNull(), whole)
        helpers = [f"_{part}_{n}" for part in ("in", "loc", "carry") for n in specs]
        return self.with_df(df.withColumns(out).drop(*helpers))

    def _carries(self, df: DataFrame, specs: Mapping[str, Scan]) -> DataFrame:
        """What each segment starts from: one row per segment, ordered per series."""
        by_segment = Window.partitionBy(*self.keys).orderBy(SEG)
        earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
        ends = []
        for n, s in specs.items():
            if isinstance(s, Running):
                ends.append(_RUNNING[s.kind](f"_in_{n}").alias(f"_loc_{n}"))
            else:
                ends.append(F.max_by(f"_loc_{n}", POS).alias(f"_loc_{n}"))
        tails = df.groupBy(*self.group).agg(*ends)
        tails = _doubling(
            tails, {f"_loc_{n}": s for n, s in specs.items()}, by_segment, self.segments, self.rows
        )
        carries = []
        for n, s in specs.items():
            if isinstance(s, Running):
                value = _RUNNING[s.kind](f"_loc_{n}").over(earlier)
            else:
                value = F.lag(f"_loc_{n}", 1).over(by_segment)
            carries.append(value.alias(f"_carry_{n}"))
        return tails.select(*self.group, *carries)

    # ------------------------------------------------------------------ whole-series values

    def totals(self, columns: Mapping[str, Column]) -> Panel:
        """Attach aggregates of the whole series (count, sum, ...) to each of its rows."""
        if not self.blocked:
            whole = Window.partitionBy(*self.keys)
            return self.with_columns({n: c.over(whole) for n, c in columns.items()})
        named = [c.alias(n) for n, c in columns.items()]
        return self.attach(self.df.groupBy(*self.keys).agg(*named))

    def attach(self, per_series: DataFrame) -> Panel:
        """Join a table with one row per series. The join key includes the segment, so a long
        series is spread over many tasks."""
        if not self.blocked:
            return self.with_df(self.df.join(per_series, list(self.keys), "left"))
        segments = self.df.groupBy(*self.group).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        return self.with_df(self.df.join(segments.join(per_series, list(self.keys)), self.group, "left"))

    def last_rows(self, *columns: str) -> DataFrame:
        """The latest row of each series: a partial aggregate, no sort of the series."""
        picked = F.max_by(F.struct(*columns), POS).alias("_last")
        return self.df.groupBy(*self.keys).agg(picked).select(*self.keys, "_last.*")


def _reach(item: Rolling | Column, side: str) -> int:
    return getattr(item, side) if isinstance(item, Rolling) else 0


# ---------------------------------------------------------------------- recurrences
#
# y[t] = c*y[t-1] + b[t] is c^t times the running sum of b[i]/c^i: one window pass, as long as the
# powers stay inside a double over the rows of a group. A faster decay over a longer group takes
# log2(n) lagged additions instead: after the step with lag m every row holds the effect of its last
# 2m rows. A step is left out only when its factor is 0 as a double, as a loop over the rows would
# have lost those terms too, so no value depends on how a series is laid out. All recurrences of a call share
# the same passes.


def _fits(coef: float, rows: int) -> bool:
    return coef > 0 and -math.log(coef) * rows < _LARGEST_LOG


def _doubling(
    df: DataFrame, specs: Mapping[str, Scan], w: WindowSpec, rows: int, unit: int
) -> DataFrame:
    m = 1
    active = {n: s for n, s in specs.items() if isinstance(s, Affine)}
    while m < rows and (active := {n: s for n, s in active.items() if s.coef ** (unit * m) != 0.0}):
        df = df.withColumns(
            {
                n: F.col(n) + F.lit(s.coef ** (unit * m)) * F.coalesce(F.lag(n, m).over(w), F.lit(0.0))
                for n, s in active.items()
            }
        )
        m *= 2
    return df


def _next_slot(slot: Column, keys: Sequence[str], order: str) -> Column:
    """Row number from 0, and an error where two bars of a series share a calendar slot: the number of
    slots is what bounds a group and the powers in it."""
    w = Window.partitionBy(*keys).orderBy(order)
    number = (F.row_number().over(w) - 1).cast("long")
    message = F.lit("two bars of a series in one calendar slot: choose a finer grain, or remove repeated bars")
    return F.when(F.lag(slot).over(w) == slot, F.raise_error(message).cast("long")).otherwise(number)


def arrange(
    df: DataFrame,
    keys: Sequence[str] = ("symbol",),
    order: str = "ts",
    grain: str | int | None = None,
    rows: int = SEGMENT_ROWS,
    slots: int | None = None,
) -> Panel:
    """Lay out bars for ordered work. (keys, order) must be unique.

    ``grain`` is the calendar slot that holds one bar of a series at most: a day for dates, and to be
    given for timestamps. A second bar in a slot is an error when the rows are numbered.
    ``slots`` is the calendar bound (see ``calendar_slots``); it is measured on ``df`` when not
    given. Pass the one measured on the raw ticks when ``df`` is costly to compute.
    """
    keys = tuple(keys)
    if grain is None:
        if not isinstance(df.schema[order].dataType, T.DateType):
            raise ValueError(f"{order} is a timestamp: say by grain how far apart bars are")
        grain = "day"
    slot = slot_number(df, order, grain)
    if slots is None:
        slots = calendar_slots(df, order, grain)
    if slots <= rows:
        # The shuffle that windows need anyway, spelled out so that it keeps the configured number
        # of partitions: window work grows with rows and columns in a way the size of the shuffle
        # does not show, and merging small partitions by size would leave cores idle.
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(parts, *keys)
        return Panel(df.withColumn(POS, _next_slot(slot, keys, order)), keys, order, max(slots, 1), 1)
    # Count bars per calendar stretch, add up the counts of earlier stretches, number within.
    stretch = F.floor(slot / rows)
    staged = df.withColumn("_stretch", stretch)
    at = [*keys, "_stretch"]
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = _next_slot(slot, at, order)
    placed = staged.join(offsets, at).withColumn(POS, (F.col("_before") + within).cast("long"))
    placed = placed.withColumn(SEG, F.floor(F.col(POS) / rows).cast("long")).drop("_stretch", "_before")
    return Panel(placed, keys, order, rows, -(-slots // rows))
