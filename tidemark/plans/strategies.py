"""The rule library under its timings and metric families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.indicators import above_rolling_mean, add_atr, change, sma
from tidemark.functions.scalars import flag
from tidemark.operators import analysis as A
from tidemark.operators import backtest as B
from tidemark.operators import joins as J
from tidemark.operators.panel import Rolling
from tidemark.operators.scoring import Leg, score
from tidemark.plans.base import (
    ATR_STEP,
    COMPARED_SQL,
    PERIODS,
    RULES_SQL,
    bars_sql,
    by_regime_sql,
    daily,
    full,
    market_sql,
    metrics_sql,
    q6,
    query,
    returns_sql,
    rounded,
    w,
    with_signal,
)
from tidemark.plans.ingest import PERIODS_SQL
from tidemark.sources.bars import period_panel

_COMPLETE = "ma20 IS NOT NULL AND ret10 IS NOT NULL AND rvol IS NOT NULL"


def _legs_sql(rules: dict[str, tuple[str, str]], source: str = "market", keep: str = "TRUE", ids: str = "symbol") -> str:
    """rules: name to (position, return over `pos`); one row per bar and rule, as `legs`."""
    parts = []
    for name, (position, earned) in rules.items():
        inner = f"SELECT *, CAST({position} AS DOUBLE) AS pos FROM {source}"
        parts.append(f"SELECT {ids}, '{name}' AS strategy, ts, pos AS p, {earned} AS r, {keep} AS keep FROM ({inner})")
    return f"legs AS ({' UNION ALL '.join(parts)})"


_LAGGED = f"lag(pos) {w()} * ret"


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {_legs_sql({n: (p, _LAGGED) for n, p in RULES_SQL.items()}, keep=_COMPLETE)},
kept AS (SELECT * FROM legs WHERE keep AND r IS NOT NULL), {metrics_sql('kept', 'symbol, strategy', 'B')} SELECT * FROM metrics"""
)
def rule_library(spark, sf_dir):
    """Every registered rule on yesterday's position, over complete rows (family B)."""
    more, legs = B.rule_layers({n: B.Rule(rule()) for n, rule in R.RULES.items()})
    panel = with_signal(daily(spark, sf_dir)).roll(*B.market_layers(), *more)
    complete = F.expr(_COMPLETE)
    for leg in legs:
        complete = complete & F.col(leg.ret).isNotNull()
    return rounded(score(panel.where(complete), legs, "B"))


_SAME_BAR = {
    "baseline": RULES_SQL["model"],
    "conservative": "signal * (CASE WHEN high_vol = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)",
    "trend scaled": RULES_SQL["trend_scaled"],
}


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {_legs_sql({n: (p, 'pos * ret') for n, p in _SAME_BAR.items()})},
{metrics_sql('legs', 'symbol, strategy', 'A0')} SELECT * FROM metrics"""
)
def same_bar_rules(spark, sf_dir):
    """Three rules that earn the bar they decide on (family A0)."""
    rules = {"baseline": R.model(), "conservative": R.conservative(0.5), "trend scaled": R.trend_scaled()}
    more, legs = B.rule_layers({n: B.Rule(p, "same_bar") for n, p in rules.items()})
    panel = with_signal(daily(spark, sf_dir)).roll(*B.market_layers(), *more)
    return rounded(score(panel, legs, "A0"))


_LAG_SIGNAL = {
    "baseline": "1.0::DOUBLE",
    "conservative": "(CASE WHEN high_vol = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)",
    "trend scaled": by_regime_sql("2.0::DOUBLE", "0.5::DOUBLE", "1.0::DOUBLE"),
}


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {_legs_sql({n: ('signal', f'lag(pos) {w()} * {x} * ret') for n, x in _LAG_SIGNAL.items()})},
kept AS (SELECT * FROM legs WHERE r IS NOT NULL), {metrics_sql('legs', 'symbol, strategy', 'B1')} SELECT * FROM metrics"""
)
def lagged_signal_rules(spark, sf_dir):
    """Yesterday's signal scaled by today's regime (family B1)."""
    scales = {"baseline": None, "conservative": R.volatility_cut(0.5), "trend scaled": R.trend_scale()}
    more, legs = B.rule_layers({n: B.Rule(R.model(), "lag_signal", x) for n, x in scales.items()})
    panel = with_signal(daily(spark, sf_dir)).roll(*B.market_layers(), *more)
    return rounded(score(panel, legs, "B1"))


_SWITCHED = (
    "CASE WHEN ts BETWEEN DATE '1998-01-01' AND DATE '1999-03-01' THEN "
    + RULES_SQL["mean_reversion"]
    + " ELSE "
    + RULES_SQL["trend_scaled"]
    + " END"
)


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {_legs_sql({'date switched': (_SWITCHED, _LAGGED)}, keep=_COMPLETE)},
kept AS (SELECT * FROM legs WHERE keep AND r IS NOT NULL), {metrics_sql('kept', 'symbol, strategy', 'B')} SELECT * FROM metrics"""
)
def date_switched_rule(spark, sf_dir):
    """Mean reversion inside a date window, trend scaling outside."""
    more, legs = B.rule_layers({"date switched": B.Rule(R.date_switched("1998-01-01", "1999-03-01"))})
    panel = with_signal(daily(spark, sf_dir)).roll(*B.market_layers(), *more)
    return rounded(score(panel.where(F.expr(_COMPLETE) & F.col("ret_0").isNotNull()), legs, "B"))


def _compared_legs(source: str = "market", by: str = "symbol", ids: str = "symbol") -> str:
    rules = {"Buy & Hold": ("NULL", "ret")} | {n: (p, f"lag(pos) {w(by=by)} * ret") for n, p in COMPARED_SQL.items()}
    return _legs_sql(rules, source, ids=ids)


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {_compared_legs()}, {metrics_sql('legs', 'symbol, strategy', 'C')} SELECT * FROM metrics"""
)
def compared_strategies(spark, sf_dir):
    """The six strategies side by side (family C)."""
    panel, legs = B.compare(with_signal(daily(spark, sf_dir)))
    return rounded(score(panel, legs, "C"))


_NAMES = list(B.COMPARED)


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {returns_sql()} SELECT symbol, ts, """
    + ", ".join(q6(c, f'"{n}"') for c, n in zip(("bh", "ma", "ml", "cv", "tc", "mr"), _NAMES))
    + " FROM rets"
)
def strategy_return_export(spark, sf_dir):
    """Daily returns, one column per strategy under its display name."""
    return rounded(B.strategy_returns(with_signal(daily(spark, sf_dir))).select("symbol", "ts", *[f"`{n}`" for n in _NAMES]))


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {returns_sql()},
long AS ({' UNION ALL '.join(f"SELECT symbol, ts, '{label}' AS strategy, {c} AS ret FROM rets" for c, label in
    zip(('bh', 'ma', 'ml', 'cv', 'tc', 'mr'), ('Buy & Hold', 'MA Crossover', *B.LABEL_OF.values())))})
SELECT symbol, ts, strategy, {q6('ret')} FROM long"""
)
def labelled_returns(spark, sf_dir):
    """The same as a long table, names replaced by labels where there is one."""
    wide = B.strategy_returns(with_signal(daily(spark, sf_dir))).table()
    return rounded(J.rename_strategies(J.unpivot_returns(wide, _NAMES), B.LABEL_OF).select("symbol", "ts", "strategy", "ret"))


@query(
    f"""WITH {bars_sql()}, {market_sql()}, {returns_sql()} SELECT symbol, ts, {q6('ml', '"ML-Based"')}, {q6('mr', '"Mean-Reversion"')} FROM rets"""
)
def repivoted_returns(spark, sf_dir):
    """Long to wide again, two strategies."""
    wide = B.strategy_returns(with_signal(daily(spark, sf_dir))).table()
    names = ["ML-Based", "Mean-Reversion"]
    return rounded(J.pivot_returns(J.unpivot_returns(wide, names), names))


def batch(spark, sf_dir):
    """Six strategies in five periods; indicators restart in each, the signal is always on, and
    high volatility is a range above its own mean."""
    bars = daily(spark, sf_dir)
    panel = add_atr(period_panel(bars.table(), PERIODS, slots=bars.rows * bars.segments))
    panel = panel.with_columns({"signal": F.lit(1), "proba": F.lit(1.0)})
    valid = F.col("ma20").isNotNull()
    averages = {
        "raw_ret": change("close"),
        "ma5": sma("close", 5),
        "ma20": sma("close", 20),
        "high_vol": above_rolling_mean("atr", 20),
    }
    # Rows before the averages are full are not there: the next row has neither return nor position.
    flags = {"trend_5_20": flag(F.col("ma5") > F.col("ma20")), "_valid": valid}
    ret = {"ret": Rolling(lambda w: F.when(F.lag("_valid", 1).over(w), F.col("raw_ret")), back=1)}
    more, legs = B.rule_layers({n: B.Rule(F.when(F.col("_valid"), r.position)) for n, r in B.compared_rules().items()})
    panel = panel.roll(averages, flags, ret, *more).where(F.col("_valid"))
    return score(panel, [Leg("Buy & Hold", "ret"), *legs], "C")


_BY = "symbol, period"
_BATCH = f"""{bars_sql()}, {PERIODS_SQL},
sliced AS (SELECT b.*, period FROM bars b JOIN periods ON ts >= starts AND ts < ends),
numbered AS (SELECT *, row_number() {w(by=_BY)} AS rn, greatest(high - low, abs(high - lag(close) {w(by=_BY)}),
  abs(low - lag(close) {w(by=_BY)})) AS tr FROM sliced),
ranged AS MATERIALIZED (SELECT *, avg(tr) {w('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW', _BY)} AS tr5 FROM numbered),
states AS (SELECT symbol, period, rn, 0.0::DOUBLE AS atr FROM ranged WHERE rn = 1 UNION ALL
  SELECT n.symbol, n.period, n.rn, {ATR_STEP[1]} FROM states e JOIN ranged n ON n.symbol = e.symbol AND n.period = e.period AND n.rn = e.rn + 1),
joined AS (SELECT r.*, atr, 1 AS signal, 1.0::DOUBLE AS proba, {full('avg', 'close', 5, _BY)} AS ma5, {full('avg', 'close', 20, _BY)} AS ma20
  FROM (SELECT r.*, s.atr FROM ranged r JOIN states s USING (symbol, period, rn)) r),
flagged AS (SELECT *, CASE WHEN ma5 > ma20 THEN 1 ELSE 0 END AS trend_5_20,
  CASE WHEN atr > ({full('avg', 'atr', 20, _BY)}) THEN 1 ELSE 0 END AS high_vol FROM joined),
trimmed AS (SELECT *, close / lag(close) {w(by=_BY)} - 1 AS ret FROM flagged WHERE ma20 IS NOT NULL),
{_compared_legs('trimmed', _BY, _BY)}, {metrics_sql('legs', 'symbol, period, strategy', 'C')}"""


@query(f"WITH RECURSIVE {_BATCH} SELECT * FROM metrics")
def period_batch(spark, sf_dir):
    return rounded(batch(spark, sf_dir))


_PIVOT = ", ".join(f"max(sharpe) FILTER (WHERE strategy = '{n}') AS \"{n}\"" for n in _NAMES)


@query(f"WITH RECURSIVE {_BATCH} SELECT symbol, period, {_PIVOT} FROM metrics GROUP BY 1, 2")
def period_sharpe_table(spark, sf_dir):
    """Sharpe per period and strategy, one column per strategy."""
    return A.pivot_metrics(rounded(batch(spark, sf_dir)), ["symbol", "period"], _NAMES, "sharpe")


@query(
    f"""WITH RECURSIVE {_BATCH} SELECT symbol, period, {_PIVOT.replace('sharpe', 'max_drawdown')} FROM metrics GROUP BY 1, 2"""
)
def period_drawdown_table(spark, sf_dir):
    return A.pivot_metrics(rounded(batch(spark, sf_dir)), ["symbol", "period"], _NAMES, "max_drawdown")


@query(f"WITH RECURSIVE {_BATCH} SELECT symbol, period, {_PIVOT.replace('sharpe', 'ann_return')} FROM metrics GROUP BY 1, 2")
def period_return_table(spark, sf_dir):
    return A.pivot_metrics(rounded(batch(spark, sf_dir)), ["symbol", "period"], _NAMES, "ann_return")


@query(
    f"""WITH RECURSIVE {_BATCH}, named AS (SELECT symbol, strategy || ' (Period ' || period || ')' AS title, sharpe FROM metrics)
SELECT symbol, CAST(regexp_extract(title, 'Period ([0-9])', 1) AS INTEGER) AS period,
regexp_replace(title, ' *[(]Period [0-9][)]', '') AS strategy, sharpe FROM named"""
)
def period_titles(spark, sf_dir):
    """Titles such as "Mean-Reversion (Period 3)" taken apart again."""
    title = F.format_string("%s (Period %d)", "strategy", "period")
    titled = rounded(batch(spark, sf_dir)).select("symbol", title.alias("title"), "sharpe")
    return titled.select(
        "symbol",
        F.regexp_extract("title", r"Period (\d)", 1).cast("int").alias("period"),
        F.regexp_replace("title", r"\s*\(Period \d\)", "").alias("strategy"),
        "sharpe",
    )
