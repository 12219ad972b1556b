"""Labels, predictions and switching between strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.indicators import forward_growth
from tidemark.operators import analysis as A
from tidemark.operators import backtest as B
from tidemark.operators import labels as L
from tidemark.operators import switching as X
from tidemark.operators.panel import Panel
from tidemark.operators.scoring import monthly_metrics
from tidemark.plans.base import (
    PREDICTIONS_SQL,
    STRATEGY_LABELS,
    bars_sql,
    daily,
    market_sql,
    predictions,
    q6,
    query,
    returns_sql,
    rounded,
    w,
    with_context,
    with_signal,
)
from tidemark.plans.signals import features_sql
from tidemark.session import cut

MR, ML, CV, TC = "MeanReversion", "ML_Strategy", "Conservative_Strategy", "TCVS_Dynamic"


def returns(spark, sf_dir) -> Panel:
    """Bars with one return column per strategy, under labels."""
    return B.strategy_returns(with_signal(daily(spark, sf_dir)), labels=True)


_RETS = f"""{bars_sql()}, {market_sql()}, {returns_sql()}"""
_FILLED = "filled AS (SELECT symbol, ts, coalesce(ml, 0) AS ml, coalesce(cv, 0) AS cv, coalesce(tc, 0) AS tc, coalesce(mr, 0) AS mr FROM rets)"
_WINNER = f"""{_FILLED}, labelled AS (SELECT *, CASE WHEN ml >= greatest(cv, tc, mr) THEN '{ML}' WHEN cv >= greatest(tc, mr) THEN '{CV}'
  WHEN tc >= mr THEN '{TC}' ELSE '{MR}' END AS best_strategy FROM filled)"""


def winners(spark, sf_dir):
    return L.label_daily_winner(returns(spark, sf_dir).df, STRATEGY_LABELS)


@query(f"WITH {_RETS}, {_WINNER} SELECT symbol, ts, best_strategy FROM labelled")
def daily_winners(spark, sf_dir):
    return winners(spark, sf_dir).select("symbol", "ts", "best_strategy")


_G = f"product(1 + {{}}) {w('ROWS BETWEEN 20 PRECEDING AND CURRENT ROW')}"


@query(
    f"""WITH {_RETS}, kept AS (SELECT * FROM rets WHERE mr IS NOT NULL AND cv IS NOT NULL),
grown AS (SELECT *, count(*) {w('ROWS BETWEEN 20 PRECEDING AND CURRENT ROW')} AS n, {_G.format('mr')} AS a, {_G.format('cv')} AS b FROM kept)
SELECT symbol, ts, CASE WHEN n = 21 AND round(a - b, 12) > 0 THEN 'MR' ELSE 'ML' END AS best_strategy FROM grown"""
)
def rolling_winners(spark, sf_dir):
    """Mean reversion against the conservative rule over 21 rows."""
    panel = returns(spark, sf_dir).where(F.col(MR).isNotNull() & F.col(CV).isNotNull())
    return L.label_rolling_winner(panel, MR, CV, 21).select("symbol", "ts", "best_strategy")


_S = f"sum({{}}) {w('ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')}"


@query(
    f"""WITH {_RETS}, {_FILLED}, summed AS (SELECT symbol, ts, count(*) {w('ROWS BETWEEN 29 PRECEDING AND CURRENT ROW')} AS n,
{', '.join(f'{_S.format(c)} AS {c}' for c in ('ml', 'cv', 'tc', 'mr'))} FROM filled)
SELECT symbol, ts, CASE WHEN n = 30 AND mr > ml AND mr > cv AND mr > tc THEN 1 ELSE 0 END AS dominates FROM summed"""
)
def dominance_flags(spark, sf_dir):
    """Rows where mean reversion's last 30 returns beat every other strategy's."""
    return L.dominance(returns(spark, sf_dir), MR, [ML, CV, TC], 30).select("symbol", "ts", "dominates")


@query(
    f"""WITH {_RETS}, {_WINNER}, ahead AS (SELECT symbol, ts, best_strategy, lead(best_strategy, 21) {w()} AS next_label FROM labelled)
SELECT * FROM ahead WHERE next_label IS NOT NULL"""
)
def next_month_labels(spark, sf_dir):
    panel = returns(spark, sf_dir)
    panel = panel.with_df(L.label_daily_winner(panel.df, STRATEGY_LABELS))
    return L.label_ahead(panel, "best_strategy", 21).select("symbol", "ts", "best_strategy", "next_label")


@query(
    f"""WITH {bars_sql()}, ahead AS (SELECT symbol, ts, lead(close) {w()} / close - 1 AS r FROM bars)
SELECT symbol, ts, CAST(r > 0 AS INTEGER) AS target FROM ahead WHERE r IS NOT NULL"""
)
def direction_targets(spark, sf_dir):
    return L.label_direction(daily(spark, sf_dir)).select("symbol", "ts", "target")


@query(
    f"""WITH {bars_sql()}, {PREDICTIONS_SQL} SELECT strategy, count(*) AS n, {q6('100.0::DOUBLE * count(*) / sum(count(*)) OVER ()', 'percent')}
FROM predictions GROUP BY strategy"""
)
def strategy_frequency(spark, sf_dir):
    return rounded(A.frequency(predictions(daily(spark, sf_dir)), "strategy"))


@query(
    f"""WITH {_RETS}, {_WINNER}, counted AS (SELECT best_strategy, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct
FROM labelled GROUP BY 1 ORDER BY n DESC, best_strategy LIMIT 2)
SELECT list_sort(list(best_strategy)) AS top, {q6('sum(pct)', 'covered')}, CAST(round(sum(pct), 9) >= 80 AS INTEGER) AS enough FROM counted"""
)
def top_two_coverage(spark, sf_dir):
    return rounded(A.topk_coverage(winners(spark, sf_dir), "best_strategy", 2, 80.0))


_MODE = f"""{_RETS}, {_WINNER}, counted AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, best_strategy, count(*) AS n,
min(ts) AS seen FROM labelled GROUP BY 1, 2, 3),
modes AS (SELECT symbol, month, best_strategy, n FROM counted
  QUALIFY row_number() OVER (PARTITION BY symbol, month ORDER BY n DESC, seen, best_strategy) = 1)"""


def modes(spark, sf_dir):
    return A.monthly_mode(winners(spark, sf_dir), "best_strategy")


@query(f"WITH {_MODE} SELECT * FROM modes")
def monthly_modes(spark, sf_dir):
    return modes(spark, sf_dir)


_MOVES = """moves AS (SELECT best_strategy AS cur, lag(best_strategy) OVER (PARTITION BY symbol ORDER BY month) AS prev FROM modes),
shares AS (SELECT prev AS previous, cur AS current, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prev) AS share
  FROM moves WHERE prev IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {_MODE}, {_MOVES} SELECT previous, current, n, {q6('share')} FROM shares")
def monthly_transitions(spark, sf_dir):
    return rounded(A.transitions(modes(spark, sf_dir), "best_strategy"))


@query(
    f"""WITH {_MODE}, {_MOVES} SELECT previous, """
    + ", ".join(q6(f"coalesce(max(share) FILTER (WHERE current = '{s}'), 0)", s) for s in STRATEGY_LABELS)
    + " FROM shares GROUP BY previous"
)
def transition_matrix(spark, sf_dir):
    return rounded(A.transition_matrix(modes(spark, sf_dir), "best_strategy", STRATEGY_LABELS))


@query(
    f"""WITH {bars_sql()}, {PREDICTIONS_SQL} SELECT CAST(date_trunc('month', ts) AS DATE) AS month, """
    + ", ".join(f"count(*) FILTER (WHERE strategy = '{s}') AS {s}" for s in STRATEGY_LABELS)
    + " FROM predictions GROUP BY 1"
)
def monthly_strategy_counts(spark, sf_dir):
    return A.monthly_counts(predictions(daily(spark, sf_dir)), "strategy", STRATEGY_LABELS)


_DESCRIBED = ("rsi", "macd", "rvol", "ret", "ret5", "ret10", "vix", "trend_5_20", "high_vol")


def labelled_features(spark, sf_dir):
    """Features of complete rows beside each day's winner, as a table: the report reads it three
    times."""
    panel = with_signal(with_context(daily(spark, sf_dir), spark, sf_dir))
    panel = B.features(B.strategy_returns(panel, labels=True))
    labelled = L.label_daily_winner(panel.df, STRATEGY_LABELS)
    return cut(labelled.select("symbol", "ts", "close", *_DESCRIBED, "trend_highvol", "best_strategy").dropna(), "labelled")


def _described_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT best_strategy, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM both_1" for c in _DESCRIBED)
    return f"""WITH RECURSIVE {features_sql()}, {returns_sql()}, {_WINNER},
both_1 AS (SELECT f.*, best_strategy FROM features f JOIN labelled l ON l.symbol = f.symbol AND l.ts = f.ts
  WHERE macd IS NOT NULL AND rvol IS NOT NULL AND ret10 IS NOT NULL AND rsi IS NOT NULL),
long AS ({parts})
SELECT best_strategy, feature, count(v) AS n, {q6('avg(v)', 'mean')}, {q6('stddev_samp(v)', 'std')}, {q6('min(v)', 'min')},
{q6('quantile_cont(v, 0.25)', 'p25')}, {q6('quantile_cont(v, 0.5)', 'p50')}, {q6('quantile_cont(v, 0.75)', 'p75')}, {q6('max(v)', 'max')}
FROM long GROUP BY 1, 2"""


@query(_described_sql())
def features_by_winner(spark, sf_dir):
    """Distribution of nine features on the days each strategy wins."""
    return rounded(A.describe_by(labelled_features(spark, sf_dir), "best_strategy", _DESCRIBED))


_EVENTS = f"""{_RETS}, summed AS (SELECT symbol, ts, CASE WHEN mr IS NOT NULL THEN sum(mr) {w('ROWS UNBOUNDED PRECEDING')} END
- CASE WHEN tc IS NOT NULL THEN sum(tc) {w('ROWS UNBOUNDED PRECEDING')} END AS diff FROM rets),
signed AS (SELECT *, CASE WHEN round(diff, 12) > 0 THEN 1 ELSE -1 END AS sgn FROM summed),
changed AS (SELECT *, CASE WHEN sgn <> lag(sgn) {w()} THEN 1 ELSE 0 END AS event FROM signed)"""


def events(spark, sf_dir) -> Panel:
    return A.crossover_events(returns(spark, sf_dir), MR, TC)


@query(f"WITH {_EVENTS} SELECT symbol, ts, {q6('diff')}, sgn AS lead, event FROM changed")
def lead_changes(spark, sf_dir):
    """Where the summed returns of two strategies overtake each other."""
    return rounded(events(spark, sf_dir).select("symbol", "ts", "diff", "lead", "event"))


_PROFILED = ("close", "ma5", "ret5", "rvol", "trend_5_20", "volume")


def _event_profile_sql() -> str:
    sides = ", ".join(f"p.{c} AS pre_{c}, q.{c} AS post_{c}" for c in _PROFILED)
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {q6(f'avg(pre_{c})', 'pre_avg')}, {q6(f'avg(post_{c})', 'post_avg')}, "
        f"{q6(f'avg(post_{c}) - avg(pre_{c})', 'change')} FROM found"
        for c in _PROFILED
    )
    return f"""WITH {_EVENTS}, found AS (SELECT {sides} FROM changed e JOIN market p ON p.symbol = e.symbol AND p.ts = e.ts - INTERVAL 5 DAY
  JOIN market q ON q.symbol = e.symbol AND q.ts = e.ts + INTERVAL 5 DAY WHERE event = 1) {parts}"""


@query(_event_profile_sql())
def event_feature_profile(spark, sf_dir):
    """Features five calendar days before and after each change of lead."""
    rows = cut(events(spark, sf_dir).df.select("symbol", "ts", "event", *_PROFILED), "profiled")
    return rounded(A.event_profile(rows.where("event = 1"), rows, _PROFILED, 5))


@query(
    f"""WITH {bars_sql()}, {PREDICTIONS_SQL}, firsts AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, arg_min(strategy, ts) AS strategy
FROM predictions WHERE probability > 0.6::DOUBLE GROUP BY 1, 2) SELECT * FROM firsts"""
)
def confident_first_of_month(spark, sf_dir):
    """The month's first prediction above 0.6."""
    confident = predictions(daily(spark, sf_dir)).where(F.col("probability") > 0.6)
    return X.first_in_month(confident, ["symbol"], "strategy")


_FORWARD = f"""{_RETS}, {PREDICTIONS_SQL},
ends AS (SELECT symbol, arg_min(strategy, ts) AS strategy, max(ts) AS ts FROM predictions GROUP BY symbol, date_trunc('month', ts)
  HAVING max(ts) = last_day(max(ts))),
ahead AS (SELECT symbol, ts, {', '.join(
    f"CASE WHEN lead(1, 30) {w()} = 1 THEN coalesce(product(1 + {c}) {w('ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING')}, 1) - 1 END AS {c}"
    for c in ('ml', 'cv', 'tc', 'mr'))} FROM rets),
chosen AS (SELECT symbol, ts, strategy, CASE strategy WHEN '{ML}' THEN ml WHEN '{CV}' THEN cv WHEN '{TC}' THEN tc WHEN '{MR}' THEN mr END AS forward
  FROM ends JOIN ahead USING (symbol, ts))"""


def forward_returns(spark, sf_dir):
    """Month ends that are sessions, the month's first predicted strategy and its return over the
    next 30 rows."""
    panel = returns(spark, sf_dir)
    months = X.first_in_month(predictions(panel), ["symbol"], "strategy", "end").withColumnRenamed("month", "ts")
    ahead = panel.roll({f"f_{s}": forward_growth(s, 30) for s in STRATEGY_LABELS})
    joined = months.join(ahead.select("symbol", "ts", *[f"f_{s}" for s in STRATEGY_LABELS]), ["symbol", "ts"])
    forward = X.pick("strategy", {s: F.col(f"f_{s}") for s in STRATEGY_LABELS})
    return joined.select("symbol", "ts", "strategy", forward.alias("forward")).where(F.col("forward").isNotNull())


@query(f"WITH {_FORWARD} SELECT symbol, ts, strategy, {q6('forward')} FROM chosen WHERE forward IS NOT NULL")
def month_end_forward_returns(spark, sf_dir):
    return rounded(forward_returns(spark, sf_dir))


@query(
    f"""WITH {_FORWARD} SELECT strategy, {q6('avg(forward)', 'mean_forward')}, count(*) AS n FROM chosen WHERE forward IS NOT NULL
GROUP BY 1 ORDER BY avg(forward) DESC"""
)
def forward_return_by_strategy(spark, sf_dir):
    return rounded(A.forward_by_strategy(forward_returns(spark, sf_dir), "strategy", "forward"))


_MONTHLY = f"""{_RETS}, {PREDICTIONS_SQL},
common AS (SELECT r.*, strategy, probability, CAST(date_trunc('month', r.ts) AS DATE) AS month FROM predictions p JOIN rets r USING (symbol, ts)),
chosen AS (SELECT symbol, month, arg_min(strategy, ts) AS strategy FROM common WHERE probability > 0.6::DOUBLE GROUP BY 1, 2),
growths AS (SELECT c.symbol, c.month, any_value(h.strategy) AS strategy, product(1 + coalesce(CASE h.strategy WHEN '{ML}' THEN ml WHEN '{CV}' THEN cv
  WHEN '{TC}' THEN tc WHEN '{MR}' THEN mr END, 0)) AS growth FROM common c JOIN chosen h ON h.symbol = c.symbol AND h.month = c.month GROUP BY 1, 2),
switched AS (SELECT symbol, month, strategy, 100 * product(growth) OVER (PARTITION BY symbol ORDER BY month ROWS UNBOUNDED PRECEDING) AS equity FROM growths)"""


def monthly(spark, sf_dir):
    panel = returns(spark, sf_dir)
    wide = panel.select("symbol", "ts", *STRATEGY_LABELS)
    return X.switch_monthly(predictions(panel), wide, STRATEGY_LABELS, 0.6)


@query(f"WITH {_MONTHLY} SELECT symbol, month, strategy, {q6('equity')} FROM switched")
def monthly_switching(spark, sf_dir):
    """Follow the month's first confident prediction."""
    return rounded(monthly(spark, sf_dir))


@query(
    f"""WITH {_MONTHLY}, m_1 AS (SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY month) - 1 AS r,
max(equity) OVER (PARTITION BY symbol ORDER BY month ROWS UNBOUNDED PRECEDING) AS peak FROM switched),
m_2 AS (SELECT symbol, count(*) AS n_obs, arg_max(equity, month) AS last_e, arg_min(equity, month) AS first_e, stddev_samp(r) * sqrt(12) AS vol,
max((peak - equity) / peak) AS dd FROM m_1 GROUP BY symbol),
m_3 AS (SELECT *, pow(last_e / first_e, 12.0::DOUBLE / n_obs) - 1 AS ann FROM m_2)
SELECT symbol, n_obs, {q6('last_e', 'final_value')}, {q6('ann', 'ann_return')}, {q6('vol', 'ann_vol')}, {q6('ann / nullif(vol, 0)', 'sharpe')},
{q6('dd', 'max_drawdown')} FROM m_3"""
)
def monthly_switching_metrics(spark, sf_dir):
    return rounded(monthly_metrics(monthly(spark, sf_dir), ["symbol"]))


_CURVE = f"CASE WHEN {{0}} IS NOT NULL THEN product(1 + {{0}}) {w('ROWS UNBOUNDED PRECEDING')} END"


@query(
    f"""WITH {_RETS}, {PREDICTIONS_SQL}, followed AS (SELECT r.*, coalesce(CASE strategy WHEN '{ML}' THEN ml WHEN '{CV}' THEN cv WHEN '{TC}' THEN tc
WHEN '{MR}' THEN mr END, 0) AS pr FROM rets r JOIN predictions USING (symbol, ts))
SELECT symbol, ts, {q6('pr', 'predicted_return')}, {q6(f"product(1 + pr) {w('ROWS UNBOUNDED PRECEDING')}", 'predicted_curve')},
{', '.join(q6(_CURVE.format(c), f'{c}_curve') for c in ('ml', 'cv', 'tc', 'mr'))} FROM followed"""
)
def daily_switching(spark, sf_dir):
    """Follow each day's prediction, beside the four strategies."""
    panel = returns(spark, sf_dir)
    predicted = predictions(panel).select("symbol", "ts", "strategy")
    panel = panel.with_df(panel.df.join(predicted, ["symbol", "ts"]))
    curves = {ML: "ml_curve", CV: "cv_curve", TC: "tc_curve", MR: "mr_curve"}
    panel = X.switch_daily(panel, "strategy", curves)
    return rounded(panel.select("symbol", "ts", "predicted_return", "predicted_curve", *curves.values()))
