"""Positions that are held for a number of quiet rows, the one rule with state that no window
function expresses.

A signal row is on; if the budget is empty it fills it with ``hold``. A quiet row with budget left is
on and spends one unit. Other rows are off.

All signals of a row travel as the bits of one long, and the budgets as bit planes, so one fold
serves a whole sweep. The rows of a window group, whose number is bounded, become one array that is folded
inside the engine. For a series cut into segments a first fold finds where each segment ends from every
possible start; chaining those ends, one row per segment, gives the real starts for the second fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import POS, SEG, Panel

MAX_SIGNALS = 62
#: Rows whose positions are collected before they join the rest of the group.
_BLOCK = 64


def _step(n_bits: int, hold: int) -> tuple[str, list[str]]:
    """SQL for one row with signals ``m`` on state ``a``: the positions and the next budget planes."""
    left = "(" + " | ".join(f"a.p{j}" for j in range(n_bits)) + ")"
    fill, spend, planes = f"(m & ~{left})", f"({left} & ~m)", []
    for j in range(n_bits):
        lower = "".join(f" & ~a.p{i}" for i in range(j))
        planes.append(f"(a.p{j} ^ ({spend}{lower}))" + (f" | {fill}" if hold >> j & 1 else ""))
    return f"(m | {left})", planes


def _state(planes: Sequence[str], out: str | None = None) -> str:
    fields = [f"'p{j}', {plane}" for j, plane in enumerate(planes)] + ([f"'out', {out}"] if out else [])
    return f"named_struct({', '.join(fields)})"


_NONE = "cast(array() as array<bigint>)"


def _positions(masks: str, starts: Sequence[str], hold: int) -> str:
    """SQL for the positions of all rows as array<bigint>: blocks of rows, so that appending stays cheap."""
    on, planes = _step(len(starts), hold)
    carried = [f"acc.p{j}" for j in range(len(starts))]
    joined = _state([f"a.p{j}" for j in range(len(starts))], "concat(acc.out, a.out)")
    block = (
        f"aggregate(slice({masks}, b * {_BLOCK} + 1, {_BLOCK}), {_state(carried, _NONE)}, "
        f"(a, m) -> {_state(planes, f'array_append(a.out, {on})')}, a -> {joined})"
    )
    return f"aggregate(sequence(0, (size({masks}) - 1) div {_BLOCK}), {_state(starts, _NONE)}, (acc, b) -> {block}, acc -> acc.out)"


def _ends(masks: str, hold: int, n_bits: int, full: int) -> str:
    """SQL for the planes after the last row, from every budget that all signals may start with."""
    _, planes = _step(n_bits, hold)
    listed = ", ".join(f"a.p{j}" for j in range(n_bits))
    folds = []
    for budget in range(hold + 1):
        starts = [f"{full if budget >> j & 1 else 0}L" for j in range(n_bits)]
        folds.append(f"aggregate({masks}, {_state(starts)}, (a, m) -> {_state(planes)}, a -> array({listed}))")
    return f"array({', '.join(folds)})"


def hold_positions(
    panel: Panel, signals: Mapping[str, Column], hold: int = 5, keep: Sequence[str] | None = None
) -> Panel:
    """Add a 0/1 position per signal; a null signal is quiet. More signals than a long has bits take
    several passes. With ``keep`` only those columns stay, beside the keys and the order."""
    names = list(signals)
    if len(names) > MAX_SIGNALS:
        # The conditions may use columns, so each becomes one before the first pass.
        panel = panel.with_columns({f"_on_{i}": signals[n] for i, n in enumerate(names)})
        kept = None if keep is None else [*keep, *(f"_on_{i}" for i in range(len(names)))]
        for at in range(0, len(names), MAX_SIGNALS):
            part = range(at, min(at + MAX_SIGNALS, len(names)))
            panel = hold_positions(panel, {names[i]: F.col(f"_on_{i}") for i in part}, hold, kept)
            panel = panel.with_df(panel.df.drop(*(f"_on_{i}" for i in part)))
            kept = kept and [c for c in kept if c in panel.df.columns] + [names[i] for i in part]
        return panel
    n_bits, full = hold.bit_length(), (1 << len(names)) - 1
    mask = F.lit(0).cast("long")
    for i, signal in enumerate(signals.values()):
        mask = mask + F.when(signal, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    df, group = panel.df.withColumn("_mask", mask), panel.group
    columns = panel.df.columns if keep is None else list(dict.fromkeys([*group, panel.order, POS, *keep]))
    carried = [POS, *(c for c in columns if c not in (*group, POS))]
    row = F.struct(*carried, "_mask")
    rows = df.groupBy(*group).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    rows = rows.withColumn("_masks", F.expr("transform(_rows, r -> r._mask)"))
    starts = ["0L"] * n_bits
    if panel.blocked:
        rows = rows.join(_starts(panel, df, hold, n_bits, full), group)
        starts = [f"_start[{j}]" for j in range(n_bits)]
    placed = rows.withColumn("_ons", F.expr(_positions("_masks", starts, hold)))
    flat = placed.select(*group, F.explode(F.arrays_zip("_rows", "_ons")).alias("_z"))
    flat = flat.select(*group, *(F.col("_z._rows").getField(c).alias(c) for c in carried), F.col("_z._ons").alias("_on"))
    bits = {n: F.expr(f"CAST(shiftright(_on, {i}) & 1L AS INT)") for i, n in enumerate(names)}
    return panel.with_df(flat.select(*columns, "_on").withColumns(bits).drop("_on"))


def _starts(panel: Panel, df: DataFrame, hold: int, n_bits: int, full: int) -> DataFrame:
    """Budget planes at the start of each segment: one row per segment is chained per series."""
    masks = F.expr(f"transform(array_sort(collect_list(struct({POS}, _mask))), r -> r._mask)")
    tails = df.groupBy(*panel.group).agg(masks.alias("_masks")).select(*panel.group, F.expr(_ends("_masks", hold, n_bits, full)).alias("_ends"))
    ordered = tails.groupBy(*panel.keys).agg(F.array_sort(F.collect_list(F.struct(SEG, "_ends"))).alias("_tails"))
    following = []
    for j in range(n_bits):
        reached = []
        for budget in range(hold + 1):
            here = " & ".join(f"{'' if budget >> i & 1 else '~'}a.p{i}" for i in range(n_bits))
            reached.append(f"({here} & {full}L & t._ends[{budget}][{j}])")
        following.append("(" + " | ".join(reached) + ")")
    planes = ", ".join(f"a.p{j}" for j in range(n_bits))
    noted = f"array_append(a.out, named_struct('{SEG}', t.{SEG}, '_start', array({planes})))"
    none = f"cast(array() as array<struct<{SEG}:bigint,_start:array<bigint>>>)"
    chain = f"aggregate(_tails, {_state(['0L'] * n_bits, none)}, (a, t) -> {_state(following, noted)}, a -> a.out)"
    return ordered.select(*panel.keys, F.inline(F.expr(chain)))
