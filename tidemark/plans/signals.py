"""Indicators, features, regimes and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.functions import rules as R
from tidemark.functions.scalars import confidence, flag
from tidemark.operators import analysis as A
from tidemark.operators import backtest as B
from tidemark.operators.holding import hold_positions
from tidemark.session import cut
from tidemark.operators.panel import POS, Running
from tidemark.plans.base import (
    ATR_STEP,
    FLAG,
    NUMBERED_SQL,
    PROBA,
    RANGED_SQL,
    RSI,
    VIX_SQL,
    bars_sql,
    daily,
    ema_step,
    full,
    market_sql,
    q6,
    query,
    recurrence_sql,
    rounded,
    w,
    wilder_step,
    with_context,
    with_signal,
)

WINDOWS = R.MA_WINDOWS
_RET = f"moved AS (SELECT *, close / lag(close) {w()} - 1 AS ret FROM bars)"


@query(f"WITH {bars_sql()} SELECT symbol, ts, {', '.join(q6(full('avg', 'close', n), f'ma{n}') for n in WINDOWS)} FROM bars")
def moving_averages(spark, sf_dir):
    panel = daily(spark, sf_dir).roll(*I.sma_ladder("close", WINDOWS))
    return rounded(panel.select("symbol", "ts", *[f"ma{n}" for n in WINDOWS]))


@query(
    f"""WITH {bars_sql()}, {_RET} SELECT symbol, ts, {q6('ret')}, {q6(f'close / lag(close, 5) {w()} - 1', 'ret5')},
{q6(f'close / lag(close, 10) {w()} - 1', 'ret10')}, lag(close) {w()} AS previous, lead(close, 21) {w()} AS later,
{q6('(' + full('stddev_samp', 'ret', 10) + ') * sqrt(252)', 'vol10')}, {q6('(' + full('stddev_samp', 'ret', 5) + ') * sqrt(252)', 'vol5')},
{q6(full('sum', 'ret', 30), 'sum30')}, {q6(full('product', '(1 + ret)', 21), 'growth21')} FROM moved"""
)
def rolling_returns(spark, sf_dir):
    """Returns over 1, 5 and 10 rows, shifts, realised volatility, rolling sum and growth."""
    panel = daily(spark, sf_dir).roll(
        {
            "ret": I.change("close"),
            "ret5": I.change("close", 5),
            "ret10": I.change("close", 10),
            "previous": I.shift("close"),
            "later": I.shift("close", -21),
        },
        {
            "vol10": I.rolling_std("ret", 10, annualise=True),
            "vol5": I.rolling_std("ret", 5, annualise=True),
            "sum30": I.rolling_sum("ret", 30),
            "growth21": I.rolling_growth("ret", 21),
        },
    )
    shown = ("ret", "ret5", "ret10", "previous", "later", "vol10", "vol5", "sum30", "growth21")
    return rounded(panel.select("symbol", "ts", *shown), "previous", "later")


_SPANS = (5, 12, 26, 50, 200)
_EMA = {f"ema{n}": ema_step(f"ema{n}", n) for n in _SPANS}


def _ema_sql(key: str) -> str:
    shown = ", ".join(q6(f"ema{n}") for n in _SPANS)
    return f"""WITH RECURSIVE {bars_sql(key)}, {NUMBERED_SQL}, {recurrence_sql('emas', 'numbered', _EMA)}
SELECT n.symbol, ts, {shown} FROM numbered n JOIN emas e ON e.symbol = n.symbol AND e.rn = n.rn"""


def _emas(panel):
    panel = I.add_ema(panel, {f"ema{n}": ("close", n) for n in _SPANS})
    return rounded(panel.select("symbol", "ts", *[f"ema{n}" for n in _SPANS]))


@query(_ema_sql("l_suppkey"))
def exponential_averages(spark, sf_dir):
    return _emas(daily(spark, sf_dir))


@query(_ema_sql(FLAG))
def long_exponential_averages(spark, sf_dir):
    return _emas(daily(spark, sf_dir, FLAG))


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL},
{recurrence_sql('sums', 'numbered', {'num': ('n.high', 'n.high + e.num * 2 / 3.0::DOUBLE'), 'den': ('1.0::DOUBLE', '1 + e.den * 2 / 3.0::DOUBLE')})}
SELECT n.symbol, ts, {q6('num / den', 'ema_high')} FROM numbered n JOIN sums e ON e.symbol = n.symbol AND e.rn = n.rn"""
)
def weighted_averages(spark, sf_dir):
    """EMA of the high with weights normalised over the rows seen."""
    return rounded(I.add_weighted_ema(daily(spark, sf_dir), "ema_high", "high", 5).select("symbol", "ts", "ema_high"))


_WILDER = {"au": wilder_step("au", 14, "up"), "ad": wilder_step("ad", 14, "down")}


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {RANGED_SQL}, {recurrence_sql('states', 'ranged', {**_WILDER, 'atr': ATR_STEP})}
SELECT n.symbol, ts, {q6(RSI.replace('rn >=', 'n.rn >='), 'rsi')}, {q6('atr')}, {q6('atr / close', 'atr_pct')},
{q6('CASE WHEN n.rn >= 5 THEN atr END', 'atr_null')} FROM ranged n JOIN states e ON e.symbol = n.symbol AND e.rn = n.rn"""
)
def wilder_indicators(spark, sf_dir):
    """RSI over 14 rows and average true range over 5, also as a share of price."""
    panel = I.add_atr(I.add_rsi(daily(spark, sf_dir)))
    panel = panel.with_columns({"atr_pct": F.col("atr") / F.col("close"), "atr_null": F.when(F.col(POS) >= 4, F.col("atr"))})
    return rounded(panel.select("symbol", "ts", "rsi", "atr", "atr_pct", "atr_null"))


_MACD = f"""{recurrence_sql('lines', 'numbered', {'f': ema_step('f', 12), 's': ema_step('s', 26)})},
lined AS MATERIALIZED (SELECT symbol, rn, f - s AS line FROM lines),
{recurrence_sql('signs', 'lined', {'sg': ('0.0::DOUBLE', 'CASE WHEN n.rn < 26 THEN 0.0::DOUBLE WHEN n.rn = 26 THEN n.line ELSE 0.2::DOUBLE * n.line + 0.8::DOUBLE * e.sg END')})},
macds AS (SELECT l.symbol, l.rn, CASE WHEN l.rn >= 34 THEN line - sg END AS macd FROM lined l JOIN signs g ON g.symbol = l.symbol AND g.rn = l.rn)"""


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {_MACD}
SELECT n.symbol, ts, {q6('macd')} FROM numbered n JOIN macds m ON m.symbol = n.symbol AND m.rn = n.rn"""
)
def macd_histogram(spark, sf_dir):
    return rounded(I.add_macd(daily(spark, sf_dir)).select("symbol", "ts", "macd"))


_TP = "(high + low + close) / 3"


def _cci_sql() -> str:
    spread = " + ".join(f"abs(coalesce(lag(tp, {i}) {w()}, tp) - mean)" for i in range(10))
    return f"""typed AS (SELECT *, {_TP} AS tp FROM bars),
meant AS (SELECT *, {full('avg', 'tp', 10)} AS mean FROM typed),
spread AS (SELECT *, ({spread}) / 10 AS mad FROM meant),
ccis AS (SELECT symbol, ts, CASE WHEN mean IS NOT NULL THEN (tp - mean) / nullif(0.015::DOUBLE * mad, 0) END AS cci FROM spread)"""


@query(f"WITH {bars_sql()}, {_cci_sql()} SELECT symbol, ts, {q6('cci')} FROM ccis")
def channel_index(spark, sf_dir):
    """CCI over 10 rows."""
    panel = daily(spark, sf_dir).roll({"cci": I.mean_deviation_index(10)})
    return rounded(panel.select("symbol", "ts", "cci"))


def _adx_sql() -> str:
    def average(c: str) -> tuple[str, str]:
        return "0.0::DOUBLE", f"CASE WHEN n.rn < 6 THEN 0.0::DOUBLE WHEN n.rn = 6 THEN n.{c}_mean ELSE (e.{c} * 4 + n.{c}) / 5 END"

    means = ", ".join(f"avg({c}) {w('ROWS BETWEEN 4 PRECEDING AND CURRENT ROW')} AS {c}_mean" for c in ("t", "u", "d"))
    return f"""
steps AS (SELECT *, high - lag(high) {w()} AS hu, lag(low) {w()} - low AS ld FROM numbered),
moves AS (SELECT symbol, rn, CASE WHEN rn > 1 THEN tr END AS t, CASE WHEN hu > ld AND hu > 0 THEN hu WHEN rn > 1 THEN 0 END AS u,
  CASE WHEN ld > hu AND ld > 0 THEN ld WHEN rn > 1 THEN 0 END AS d, ts FROM steps),
meant_moves AS MATERIALIZED (SELECT *, {means} FROM moves),
{recurrence_sql('directed', 'meant_moves', {c: average(c) for c in ('t', 'u', 'd')})},
sided AS (SELECT symbol, rn, CASE WHEN rn >= 6 THEN 100 * u / nullif(t, 0) END AS di_pos, CASE WHEN rn >= 6 THEN 100 * d / nullif(t, 0) END AS di_neg
  FROM directed),
dxs AS (SELECT *, CASE WHEN rn >= 6 THEN coalesce(100 * abs(di_pos - di_neg) / nullif(di_pos + di_neg, 0), 0) END AS x, symbol AS ts FROM sided),
meant_dx AS MATERIALIZED (SELECT *, avg(x) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x_mean FROM dxs),
{recurrence_sql('trended', 'meant_dx', {'x': ('0.0::DOUBLE', 'CASE WHEN n.rn < 10 THEN 0.0::DOUBLE WHEN n.rn = 10 THEN n.x_mean ELSE (e.x * 4 + n.x) / 5 END')})},
adxs AS (SELECT s.symbol, s.rn, CASE WHEN s.rn >= 10 THEN t.x END AS adx, di_pos, di_neg
  FROM sided s JOIN trended t ON t.symbol = s.symbol AND t.rn = s.rn)"""


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {_adx_sql()}
SELECT n.symbol, n.ts, {q6('adx')}, {q6('di_pos')}, {q6('di_neg')} FROM numbered n JOIN adxs a ON a.symbol = n.symbol AND a.rn = n.rn"""
)
def directional_movement(spark, sf_dir):
    """ADX over 5 rows with both directional indicators."""
    return rounded(I.add_adx(daily(spark, sf_dir)).select("symbol", "ts", "adx", "di_pos", "di_neg"))


def screened(panel):
    panel = I.add_adx(I.add_rsi(I.add_weighted_ema(panel, "ema_high", "high", 5)))
    return panel.roll({"cci": I.mean_deviation_index(10)})


_SCREEN = f"""{bars_sql()}, {NUMBERED_SQL}, {_cci_sql()}, {_adx_sql()},
{recurrence_sql('sums', 'numbered', {'num': ('n.high', 'n.high + e.num * 2 / 3.0::DOUBLE'), 'den': ('1.0::DOUBLE', '1 + e.den * 2 / 3.0::DOUBLE')})},
{recurrence_sql('wilder', 'numbered', _WILDER)},
rated AS (SELECT symbol, rn, {RSI} AS rsi FROM wilder),
rows_1 AS (SELECT n.symbol, n.ts, n.rn, open, close, num / den AS ema_high, rsi, cci, adx, di_pos FROM numbered n
  JOIN sums s ON s.symbol = n.symbol AND s.rn = n.rn JOIN rated r ON r.symbol = n.symbol AND r.rn = n.rn
  JOIN adxs a ON a.symbol = n.symbol AND a.rn = n.rn JOIN ccis c ON c.symbol = n.symbol AND c.ts = n.ts),
rows_2 AS (SELECT *, lag(rsi) {w()} AS prev_rsi, lag(cci) {w()} AS prev_cci, lag(adx) {w()} AS prev_adx, lag(di_pos) {w()} AS prev_di_pos FROM rows_1),
latest AS (SELECT * FROM rows_2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"""


@query(
    f"""WITH RECURSIVE {_SCREEN} SELECT symbol, ts, {', '.join(q6(c) for c in ('open', 'close', 'ema_high', 'rsi', 'cci', 'adx', 'di_pos',
    'prev_rsi', 'prev_cci', 'prev_adx', 'prev_di_pos'))} FROM latest"""
)
def latest_two_bars(spark, sf_dir):
    """Latest bar per symbol beside the previous one's indicators."""
    used = ("rsi", "cci", "adx", "di_pos")
    panel = screened(daily(spark, sf_dir)).roll({f"prev_{c}": I.shift(c) for c in used})
    return rounded(panel.last_rows("ts", "open", "close", "ema_high", *used, *[f"prev_{c}" for c in used]))


_ENTRY = """close > ema_high AND rsi > 60 AND prev_rsi < 60 AND cci < 100 AND prev_cci < 100 AND adx > 25 AND di_pos > 25
AND prev_di_pos < prev_adx AND di_pos > adx AND open >= 100"""

# Bars whose high and low are their open and close: on the wider ones no bar ever meets all conditions.
_NARROW_SCREEN = _SCREEN.replace(" + mq / 64", "").replace(" - mq / 64", "")


@query(
    f"""WITH RECURSIVE {_NARROW_SCREEN} SELECT symbol, ts, {', '.join(q6(c) for c in ('open', 'close', 'ema_high', 'rsi', 'cci', 'adx', 'di_pos'))}
FROM rows_2 WHERE {_ENTRY}"""
)
def screened_bars(spark, sf_dir):
    """Every bar that meets all entry conditions as of its date."""
    narrow = daily(spark, sf_dir).with_columns({"high": F.greatest("open", "close"), "low": F.least("open", "close")})
    panel = A.screen_bars(screened(narrow))
    return rounded(panel.select("symbol", "ts", "open", "close", "ema_high", "rsi", "cci", "adx", "di_pos"))


@query(f"WITH RECURSIVE {_SCREEN} SELECT symbol FROM latest WHERE {_ENTRY}")
def screened_symbols(spark, sf_dir):
    """Symbols whose latest bar meets all entry conditions."""
    return A.screen(screened(daily(spark, sf_dir))).select("symbol")


FEATURES = ("ma5", "ma20", "rsi", "macd", "rvol", "ret", "ret5", "ret10", "trend_5_20", "high_vol", "trend_highvol")


def features_sql(vol_rows: int = 10) -> str:
    """All features, regimes and the context quantile, as `features`."""
    return f"""{bars_sql()}, {VIX_SQL}, {NUMBERED_SQL}, {_MACD}, {recurrence_sql('wilder', 'numbered', _WILDER)},
rated AS (SELECT symbol, rn, {RSI} AS rsi FROM wilder), {market_sql(vol_rows=vol_rows)},
cuts AS (SELECT b.symbol, quantile_cont(vix, 0.7) AS cut FROM bars b JOIN vix USING (ts) GROUP BY 1),
features AS (SELECT m.* EXCLUDE (high_vol), vix, rsi, macd, CASE WHEN vix > cut THEN 1 ELSE 0 END AS high_vol,
  trend_5_20 * CASE WHEN vix > cut THEN 1 ELSE 0 END AS trend_highvol, CASE WHEN m.close > ma5 THEN 'Up' ELSE 'Down' END AS trend,
  CASE WHEN vix > cut THEN 'High' ELSE 'Normal' END AS volatility_regime
  FROM market m JOIN vix USING (ts) JOIN cuts ON cuts.symbol = m.symbol JOIN numbered n ON n.symbol = m.symbol AND n.ts = m.ts
  JOIN rated r ON r.symbol = n.symbol AND r.rn = n.rn JOIN macds d ON d.symbol = n.symbol AND d.rn = n.rn)"""


_DOUBLES = ("ma5", "ma20", "rsi", "macd", "rvol", "ret", "ret5", "ret10")


@query(
    f"""WITH RECURSIVE {features_sql()} SELECT symbol, ts, close, vix, {', '.join(q6(c) for c in _DOUBLES)}, trend_5_20, high_vol, trend_highvol,
trend, volatility_regime FROM features WHERE ma5 IS NOT NULL AND ma20 IS NOT NULL AND rsi IS NOT NULL AND macd IS NOT NULL AND rvol IS NOT NULL
AND ret10 IS NOT NULL"""
)
def feature_table(spark, sf_dir):
    """Features and regimes; rows with any unknown feature are dropped."""
    panel = with_context(daily(spark, sf_dir), spark, sf_dir)
    panel = B.add_regimes(B.features(panel))
    shown = panel.select("symbol", "ts", "close", "vix", *FEATURES, "trend", "volatility_regime").dropna()
    return rounded(shown, "close", "vix")


@query(
    f"""WITH RECURSIVE {bars_sql()}, {NUMBERED_SQL}, {RANGED_SQL}, {recurrence_sql('states', 'ranged', {'atr': ATR_STEP})},
{market_sql(vol_rows=5)},
joined AS (SELECT m.symbol, m.ts, m.close, m.ma5, m.ma20, rvol, atr, high_vol FROM market m JOIN ranged n ON n.symbol = m.symbol AND n.ts = m.ts
  JOIN states s ON s.symbol = n.symbol AND s.rn = n.rn)
SELECT symbol, ts, high_vol AS vol_above_mean, CASE WHEN atr > ({full('avg', 'atr', 20)}) THEN 1 ELSE 0 END AS range_above_mean,
CASE WHEN ma5 > ma20 THEN 1 ELSE 0 END AS cross_trend, CASE WHEN close > ma5 THEN 1 ELSE 0 END AS price_trend FROM joined"""
)
def volatility_flags(spark, sf_dir):
    """High volatility by realised volatility over 5 rows and by range, and both trends."""
    panel = I.add_atr(daily(spark, sf_dir))
    panel = panel.roll(
        {"ret": I.change("close"), "ma5": I.sma("close", 5), "ma20": I.sma("close", 20), "range_above_mean": I.above_rolling_mean("atr", 20)},
        {"rvol": I.rolling_std("ret", 5, annualise=True)},
        {"vol_above_mean": I.above_rolling_mean("rvol", 20)},
    )
    return panel.select(
        "symbol",
        "ts",
        "vol_above_mean",
        "range_above_mean",
        flag(F.col("ma5") > F.col("ma20")).alias("cross_trend"),
        flag(F.col("close") > F.col("ma5")).alias("price_trend"),
    )


@query(
    f"""WITH {bars_sql()}, {VIX_SQL} SELECT symbol, {q6('quantile_cont(vix, 0.7)', 'vix_70')}, {q6('quantile_cont(close, 0.7)', 'close_70')}
FROM bars JOIN vix USING (ts) GROUP BY symbol"""
)
def context_thresholds(spark, sf_dir):
    """Exact quantiles per symbol."""
    from tidemark.operators.quantiles import exact_quantiles

    df = with_context(daily(spark, sf_dir), spark, sf_dir).df
    values = df.select("symbol", F.expr("stack(2, 'vix', vix, 'close', close) AS (column, value)"))
    found = exact_quantiles(cut(values, "thresholds"), ["symbol", "column"], "value", [0.7])
    at = lambda c: F.max(F.when(F.col("column") == c, F.get("q", F.lit(0)))).alias(f"{c}_70")
    return rounded(found.groupBy("symbol").agg(at("vix"), at("close")))


@query(
    f"""WITH {bars_sql()} SELECT symbol, ts, {PROBA} AS proba, {q6(f'2 * greatest({PROBA} - 0.5::DOUBLE, 0)', 'confidence')} FROM bars"""
)
def confidence_scale(spark, sf_dir):
    df = with_signal(daily(spark, sf_dir)).df
    return rounded(df.select("symbol", "ts", "proba", confidence(F.col("proba")).alias("confidence")), "proba")


@query(
    f"""WITH {bars_sql()}, {_RET},
grown AS (SELECT *, CASE WHEN ret IS NOT NULL THEN 100 * product(1 + ret) {w('ROWS UNBOUNDED PRECEDING')} END AS equity FROM moved),
peaked AS (SELECT *, max(equity) {w('ROWS UNBOUNDED PRECEDING')} AS peak, min(CASE WHEN equity IS NOT NULL THEN ts END) OVER (PARTITION BY symbol) AS t0 FROM grown),
based AS (SELECT *, max(CASE WHEN ts = t0 THEN equity END) OVER (PARTITION BY symbol) AS e0 FROM peaked)
SELECT symbol, ts, {q6('equity')}, {q6('peak - equity', 'drawdown')}, {q6('(peak - equity) / peak', 'relative')},
{q6('100 * (equity / e0 - 1)', 'path')} FROM based"""
)
def equity_curves(spark, sf_dir):
    """Growth of 100, drawdown in units and in shares of the peak, and the path since the start."""
    panel = daily(spark, sf_dir).roll({"ret": I.change("close")})
    panel = I.add_equity(panel, {"equity": "ret"}, base=100.0)
    panel = I.add_drawdown(I.add_drawdown(panel, "equity"), "equity", "relative", relative=True)
    panel = I.add_rebased(panel, "equity", "path")
    panel = panel.with_columns({c: F.when(F.col("equity").isNotNull(), F.col(c)) for c in ("drawdown", "relative", "path")})
    return rounded(panel.select("symbol", "ts", "equity", "drawdown", "relative", "path"))


@query(
    f"""WITH RECURSIVE {bars_sql()}, signalled AS MATERIALIZED (SELECT symbol, ts, row_number() {w()} AS rn, CAST({PROBA} > 0.85::DOUBLE AS INTEGER) AS s FROM bars),
{recurrence_sql('held', 'signalled', {'p': ('n.s', 'CASE WHEN n.s = 1 OR e.b > 0 THEN 1 ELSE 0 END'),
    'b': ('CASE WHEN n.s = 1 THEN 5 ELSE 0 END', 'CASE WHEN n.s = 1 THEN (CASE WHEN e.b = 0 THEN 5 ELSE e.b END) ELSE greatest(e.b - 1, 0) END')})}
SELECT n.symbol, ts, s AS signal, p AS position FROM signalled n JOIN held h ON h.symbol = n.symbol AND h.rn = n.rn"""
)
def held_positions(spark, sf_dir):
    """A rare signal, held for at least five quiet rows."""
    panel = with_signal(daily(spark, sf_dir))
    panel = panel.with_columns({"signal": flag(F.col("proba") > 0.85)})
    return hold_positions(panel, {"position": F.col("signal") == 1}, 5).select("symbol", "ts", "signal", "position")


@query(
    f"""WITH {bars_sql()}, {_RET}, total AS (SELECT symbol, ts, volume, CAST(sum(volume) OVER (PARTITION BY symbol) AS DOUBLE) AS v FROM moved)
SELECT symbol, ts, {q6('volume / v * 100', '"order"')} FROM total"""
)
def volume_orders(spark, sf_dir):
    """An order of 100 shares split by each bar's share of the volume."""
    return rounded(A.volume_allocation(daily(spark, sf_dir)).select("symbol", "ts", "order"))


_CORRELATED = ("close", "ret", "ret5", "rvol", "vix", "trend_5_20", "high_vol")


@query(
    f"WITH RECURSIVE {features_sql()}, kept AS (SELECT * FROM features WHERE ma20 IS NOT NULL AND rvol IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {q6(f'corr({a}, {b})', 'corr')} FROM kept" for a in _CORRELATED for b in _CORRELATED
    )
)
def feature_correlations(spark, sf_dir):
    panel = B.features(with_context(daily(spark, sf_dir), spark, sf_dir))
    return rounded(A.corr_matrix(panel.df.where("ma20 IS NOT NULL AND rvol IS NOT NULL"), _CORRELATED))


@query(
    f"""WITH {bars_sql()}, edges AS (SELECT min(close) AS lo, (max(close) - min(close)) / 50 AS width FROM bars)
SELECT CAST(least(floor((close - lo) / width), 49) AS INTEGER) AS bin, {q6('lo + least(floor((close - lo) / width), 49) * width', '"left"')},
count(*) AS n FROM bars, edges GROUP BY 1, 2"""
)
def price_histogram(spark, sf_dir):
    return rounded(A.histogram(daily(spark, sf_dir).df, "close", 50))


@query(
    f"""WITH {bars_sql()}, ranked AS (SELECT *, row_number() {w()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, ts, CAST(i <= floor(0.8::DOUBLE * n) AS INTEGER) AS train80, CAST(i <= floor(0.75::DOUBLE * n) AS INTEGER) AS train75 FROM ranked"""
)
def chronological_split(spark, sf_dir):
    panel = B.chrono_split(B.chrono_split(daily(spark, sf_dir), 0.8, "train80"), 0.75, "train75")
    return panel.select("symbol", "ts", "train80", "train75")


@query(
    f"""WITH {bars_sql()}, {_RET}, summed AS (SELECT *, sum(ret) {w('ROWS UNBOUNDED PRECEDING')} AS a,
sum(volume) {w('ROWS UNBOUNDED PRECEDING')} AS v, max(close) {w('ROWS UNBOUNDED PRECEDING')} AS top FROM moved)
SELECT symbol, ts, {q6('CASE WHEN ret IS NOT NULL THEN a END', 'total_return')}, CAST(v AS DOUBLE) AS volume_so_far, top AS high_so_far FROM summed"""
)
def running_totals(spark, sf_dir):
    panel = daily(spark, sf_dir).roll({"ret": I.change("close")})
    panel = panel.scan(
        {
            "total_return": Running("sum", F.col("ret")),
            "volume_so_far": Running("sum", F.col("volume").cast("double")),
            "high_so_far": Running("max", F.col("close")),
        }
    )
    return rounded(panel.select("symbol", "ts", "total_return", "volume_so_far", "high_so_far"), "volume_so_far", "high_so_far")
