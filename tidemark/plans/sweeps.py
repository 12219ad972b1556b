"""Parameter sweeps over moving-average pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.operators import backtest as B
from tidemark.operators.scoring import Leg, present, score
from tidemark.functions.indicators import change, sma
from tidemark.session import scratch_path
from tidemark.sources.stored import store_panel
from tidemark.plans.base import bars_sql, daily, full, metrics_sql, query, rounded, w, with_context, with_signal
from tidemark.plans.base import ATR_STEP, NUMBERED_SQL, PROBA, RANGED_SQL, RSI, VIX_SQL, ema_step, market_sql, q6, recurrence_sql, wilder_step

WINDOWS = R.MA_WINDOWS
PAIRS = R.ma_pairs()


def _long_pairs(position: str, source: str, prefix: str = "ma") -> str:
    """One row per bar and pair, with the position rule over `fast_ma` and `slow_ma`."""
    grid = ", ".join(f"({f}, {s})" for f, s in PAIRS)
    pick = " ".join(f"WHEN {n} THEN {prefix}{n}" for n in WINDOWS)
    return f"""
grid AS (SELECT * FROM (VALUES {grid}) AS t(fast, slow)),
paired AS (SELECT s.*, fast, slow, CASE fast {pick} END AS f_ma, CASE slow {pick} END AS s_ma FROM {source} s CROSS JOIN grid),
held AS (SELECT *, {position} AS p FROM paired),
legs AS (SELECT symbol, ts, fast || '/' || slow AS strategy, fast, slow, CAST(p AS DOUBLE) AS p,
  lag(p) OVER (PARTITION BY symbol, fast, slow ORDER BY ts) * ret AS r FROM held)"""


def _averages(key: str = "l_suppkey") -> str:
    mas = ", ".join(f"{full('avg', 'close', n)} AS ma{n}" for n in WINDOWS)
    return f"""WITH RECURSIVE {bars_sql(key)},
averaged AS (SELECT *, close / lag(close) {w()} - 1 AS ret, {mas} FROM bars)"""


def _sma_sql(position: str) -> str:
    return f"""{_averages()}, valid AS (SELECT * FROM averaged WHERE ma200 IS NOT NULL),
{_long_pairs(position, 'valid')}, {metrics_sql('legs', 'symbol, strategy, fast, slow', 'A')} SELECT * FROM metrics"""


@query(_sma_sql("CASE WHEN f_ma > s_ma THEN 1 ELSE 0 END"))
def sma_pairs_long_flat(spark, sf_dir):
    return rounded(B.sma_sweep(daily(spark, sf_dir)))


@query(_sma_sql("CASE WHEN f_ma > s_ma THEN 1 ELSE 0 END"))
def stored_panel_pairs(spark, sf_dir):
    """The pairs over a stored panel: the sweep reads sorted buckets, with no shuffle or sort of its own."""
    path = scratch_path(spark, "panel")
    return rounded(B.sma_sweep(store_panel(daily(spark, sf_dir), f"panel_{path[-32:]}", path)))


@query(_sma_sql("CASE WHEN f_ma > s_ma THEN 1 ELSE -1 END"))
def sma_pairs_long_short(spark, sf_dir):
    return rounded(B.sma_sweep(daily(spark, sf_dir), R.long_short))


@query(_sma_sql("CASE WHEN f_ma < s_ma THEN -1 ELSE 0 END"))
def sma_pairs_short_only(spark, sf_dir):
    return rounded(B.sma_sweep(daily(spark, sf_dir), R.short_only))


def _rsi_sql() -> str:
    moves = recurrence_sql("moves", "numbered", {"au": wilder_step("au", 14, "up"), "ad": wilder_step("ad", 14, "down")})
    return f"{NUMBERED_SQL}, {moves}, rsi AS (SELECT symbol, rn, {RSI} AS rsi FROM moves)"


@query(
    f"""{_averages()}, {_rsi_sql()},
valid AS (SELECT a.*, rsi FROM averaged a JOIN numbered n USING (symbol, ts) JOIN rsi r ON r.symbol = n.symbol AND r.rn = n.rn
  WHERE ma200 IS NOT NULL AND rsi IS NOT NULL),
{_long_pairs('CASE WHEN f_ma < s_ma AND close < ma200 AND rsi > 60 THEN -1 ELSE 0 END', 'valid')},
{metrics_sql('legs', 'symbol, strategy, fast, slow', 'A')} SELECT * FROM metrics"""
)
def filtered_short_pairs(spark, sf_dir):
    return rounded(B.sma_sweep(daily(spark, sf_dir), R.filtered_short, with_rsi=True))


_EMAS = {f"ema{n}": ema_step(f"ema{n}", n) for n in WINDOWS}


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {recurrence_sql('emas', 'numbered', _EMAS)},
valid AS (SELECT n.symbol, ts, close, close / prev_close - 1 AS ret, e.* EXCLUDE (symbol, rn)
  FROM numbered n JOIN emas e ON e.symbol = n.symbol AND e.rn = n.rn),
{_long_pairs('CASE WHEN f_ma > s_ma THEN 1 ELSE 0 END', 'valid', 'ema')},
{metrics_sql('legs', 'symbol, strategy, fast, slow', 'A')} SELECT * FROM metrics"""
)
def ema_pairs_long_flat(spark, sf_dir):
    return rounded(B.ema_sweep(daily(spark, sf_dir)))


def _confirmed_sql() -> str:
    steps = {**_EMAS, "au": wilder_step("au", 14, "up"), "ad": wilder_step("ad", 14, "down"), "atr": ATR_STEP}
    confirm = "close > ema200 AND rsi > 50 AND atr / close > 0.015::DOUBLE"
    signals = ", ".join(f"CASE WHEN ema{f} > ema{s} AND {confirm} THEN 1 ELSE 0 END AS s{i}" for i, (f, s) in enumerate(PAIRS))
    holds = {}
    for i in range(len(PAIRS)):
        holds[f"p{i}"] = (f"n.s{i}", f"CASE WHEN n.s{i} = 1 OR e.b{i} > 0 THEN 1 ELSE 0 END")
        holds[f"b{i}"] = (
            f"CASE WHEN n.s{i} = 1 THEN 5 ELSE 0 END",
            f"CASE WHEN n.s{i} = 1 THEN (CASE WHEN e.b{i} = 0 THEN 5 ELSE e.b{i} END) ELSE greatest(e.b{i} - 1, 0) END",
        )
    grid = ", ".join(f"({i + 1}, {f}, {s})" for i, (f, s) in enumerate(PAIRS))
    listed = ", ".join(f"p{i}" for i in range(len(PAIRS)))
    return f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {RANGED_SQL}, {recurrence_sql('states', 'ranged', steps)},
rated AS (SELECT n.symbol, n.ts, n.close, n.close / n.prev_close - 1 AS ret, e.* EXCLUDE (symbol, rn), CASE WHEN n.rn >= 14 THEN CASE WHEN ad = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + au / ad) END END AS rsi
  FROM ranged n JOIN states e ON e.symbol = n.symbol AND e.rn = n.rn),
signalled AS MATERIALIZED (SELECT symbol, ts, ret, row_number() {w()} AS rn, {signals} FROM rated WHERE rsi IS NOT NULL),
{recurrence_sql('holds', 'signalled', holds)},
listed AS (SELECT s.symbol, s.ts, s.ret, [{listed}] AS ps FROM signalled s JOIN holds h ON h.symbol = s.symbol AND h.rn = s.rn),
grid AS (SELECT * FROM (VALUES {grid}) AS t(i, fast, slow)),
legs AS (SELECT symbol, ts, fast || '/' || slow AS strategy, fast, slow, CAST(ps[i] AS DOUBLE) AS p,
  lag(ps[i]) OVER (PARTITION BY symbol, fast, slow ORDER BY ts) * ret AS r FROM listed CROSS JOIN grid),
{metrics_sql('legs', 'symbol, strategy, fast, slow', 'A')} SELECT * FROM metrics"""


@query(_confirmed_sql())
def confirmed_ema_pairs(spark, sf_dir):
    return rounded(B.confirmed_ema_sweep(daily(spark, sf_dir)))


@query(
    f"""{_averages()}, {_rsi_sql()},
valid AS (SELECT * FROM averaged WHERE ma200 IS NOT NULL),
held AS (SELECT *, CASE WHEN ma5 > ma20 THEN 1 WHEN ma10 < ma20 AND close < ma200 THEN -1 ELSE 0 END AS pos FROM valid),
legs AS (SELECT symbol, 'two-sided' AS strategy, ts, CAST(pos AS DOUBLE) AS p, lag(pos) {w()} * ret AS r FROM held),
{metrics_sql('legs', 'symbol, strategy', 'A')} SELECT * FROM metrics"""
)
def two_sided_averages(spark, sf_dir):
    """Long on a fast cross, short on a slower one below the long average."""
    valid = F.col("ma200").isNotNull()
    averages = {"ret": change("close"), **{f"ma{n}": sma("close", n) for n in (5, 10, 20, 200)}}
    panel = daily(spark, sf_dir).roll(averages, {"pos": F.when(valid, R.two_sided_ma())}, {"r": R.earned("pos")})
    return rounded(score(panel.where(valid), [Leg("two-sided", "r", "pos")], "A"))


@query(
    f"""WITH {bars_sql()}, {market_sql()}, valid AS (SELECT * FROM market WHERE ma20 IS NOT NULL),
held AS (SELECT *, CASE WHEN ma5 > ma20 THEN 1 ELSE 0 END AS pos FROM valid),
legs AS (SELECT symbol, 'hold' AS strategy, ts, NULL::DOUBLE AS p, ret AS r FROM held
  UNION ALL SELECT symbol, 'ma 5/20', ts, CAST(pos AS DOUBLE), lag(pos) {w()} * ret FROM held),
{metrics_sql('legs', 'symbol, strategy', 'A')} SELECT * FROM metrics"""
)
def hold_against_average(spark, sf_dir):
    valid = F.col("ma20").isNotNull()
    averages = {"ret": change("close"), "ma5": sma("close", 5), "ma20": sma("close", 20)}
    panel = daily(spark, sf_dir).roll(averages, {"pos": F.when(valid, R.long_flat("ma5", "ma20"))}, {"r": R.earned("pos")})
    return rounded(score(panel.where(valid), [Leg("hold", "ret"), Leg("ma 5/20", "r", "pos")], "A"))


@query(
    _sma_sql("CASE WHEN f_ma > s_ma THEN 1 ELSE 0 END").replace("SELECT * FROM metrics", "")
    + """SELECT symbol, fast, slow, sharpe, ann_return, final_value FROM metrics
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC NULLS LAST, fast, slow) = 1 ORDER BY sharpe DESC NULLS LAST, symbol"""
)
def best_pair(spark, sf_dir):
    """The pair of averages with the best Sharpe ratio per symbol."""
    scored = rounded(B.sma_sweep(daily(spark, sf_dir)))
    rank = F.struct(F.coalesce(-F.col("sharpe"), F.lit(float("inf"))).alias("a"), F.col("fast"), F.col("slow"))
    best = scored.groupBy("symbol").agg(F.min_by(F.struct("fast", "slow", "sharpe", "ann_return", "final_value"), rank).alias("b"))
    return best.select("symbol", "b.*").orderBy(F.desc_nulls_last("sharpe"), "symbol")


@query(
    _sma_sql("CASE WHEN f_ma > s_ma THEN 1 ELSE 0 END").replace("SELECT * FROM metrics", "")
    + """SELECT symbol, fast, slow, n_obs, round(final_value, 2) + 0.0 AS final_value, round(100 * ann_return, 2) + 0.0 AS ann_return,
round(100 * ann_vol, 2) + 0.0 AS ann_vol, round(sharpe, 3) + 0.0 AS sharpe, round(100 * max_drawdown, 2) + 0.0 AS max_drawdown
FROM metrics ORDER BY metrics.sharpe DESC NULLS LAST, symbol, fast, slow LIMIT 10"""
)
def top_pairs(spark, sf_dir):
    """The ten best rows of the sweep, in percent."""
    scored = rounded(B.sma_sweep(daily(spark, sf_dir)))
    top = scored.orderBy(F.desc_nulls_last("sharpe"), "symbol", "fast", "slow").limit(10)
    shown = ("symbol", "fast", "slow", "n_obs", "final_value", "ann_return", "ann_vol", "sharpe", "max_drawdown")
    return present(top.select(*shown)).withColumns({c: F.col(c) + 0.0 for c in shown[4:]})


@query(
    f"""{_averages()}, {VIX_SQL},
ahead AS (SELECT a.*, vix, {PROBA} AS proba, lead(close) {w()} / close - 1 AS next_ret FROM averaged a JOIN vix USING (ts)),
whole AS (SELECT *, row_number() {w()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ahead WHERE ma200 IS NOT NULL),
test AS (SELECT * FROM whole WHERE i > floor(0.8::DOUBLE * n)),
cuts AS (SELECT symbol, quantile_cont(vix, 0.7) AS cut FROM test GROUP BY symbol),
valid AS (SELECT t.* EXCLUDE (ret, next_ret), next_ret AS ret, CASE WHEN vix > cut THEN 1 ELSE 0 END AS high_vol FROM test t JOIN cuts USING (symbol)),
{_long_pairs('2 * greatest(proba - 0.5::DOUBLE, 0) * (CASE WHEN high_vol = 1 AND f_ma > s_ma THEN 2.0::DOUBLE WHEN high_vol = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)', 'valid')},
forward AS (SELECT * EXCLUDE (r), p * ret AS r FROM (SELECT l.*, v.ret FROM legs l JOIN valid v USING (symbol, ts))),
{metrics_sql('forward', 'symbol, strategy, fast, slow', 'A')} SELECT * FROM metrics"""
)
def confident_pairs(spark, sf_dir):
    """Confidence-sized positions over all pairs, on the last fifth of each series."""
    panel = with_signal(with_context(daily(spark, sf_dir), spark, sf_dir))
    return rounded(B.confident_pair_sweep(panel))


_CUTS = ", ".join(f"({k})" for k in R.EXPOSURES)


def _cut_sql() -> str:
    return f"""WITH {bars_sql()}, {market_sql()},
grid AS (SELECT CAST(k AS DOUBLE) AS exposure FROM (VALUES {_CUTS}) AS t(k)),
legs AS (SELECT symbol, 'cut ' || exposure AS strategy, exposure, ts, CAST(signal AS DOUBLE) AS p,
  lag(signal) OVER (PARTITION BY symbol, exposure ORDER BY ts) * (CASE WHEN high_vol = 1 THEN exposure ELSE 1.0::DOUBLE END) * ret AS r
  FROM market CROSS JOIN grid),
{metrics_sql('legs', 'symbol, strategy, exposure', 'B1')}"""


@query(_cut_sql() + " SELECT * FROM metrics")
def exposure_cuts(spark, sf_dir):
    """How deep to cut exposure at high volatility."""
    return rounded(B.exposure_sweep(with_signal(daily(spark, sf_dir))), "exposure")


@query(_cut_sql() + " SELECT symbol, arg_max(exposure, (sharpe, -exposure)) AS exposure, max(sharpe) AS sharpe FROM metrics GROUP BY symbol")
def best_exposure(spark, sf_dir):
    scored = rounded(B.exposure_sweep(with_signal(daily(spark, sf_dir))), "exposure")
    return B.best_parameter(scored, ["symbol"], "exposure")
