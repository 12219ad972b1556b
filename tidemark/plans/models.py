"""Training, scoring and evaluation. Trained forests have no SQL twin; their reports do."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import labels as L
from tidemark.operators import joins as J
from tidemark.operators import learning as M
from tidemark.operators import switching as X
from tidemark.operators.scoring import monthly_metrics, score
from tidemark.plans.base import PREDICTIONS_SQL, PROBA, STRATEGY_LABELS, VIX_SQL, bars_sql, daily, predictions, q6, query
from tidemark.plans.base import rounded, w, with_context, with_signal
from tidemark.plans.selection import _RETS, _WINNER, MR, returns, winners
from tidemark.session import cut, scratch_path

#: Rows that a month's label looks ahead.
MONTH_ROWS = 21
#: No forest here has fewer trees.
LEAST_TREES = 20
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def frame(spark, sf_dir, share: float | None = None, known: str | None = None, gap: int = 0):
    """Features, next-day direction, winner, dominance and the label 21 rows ahead, as a table. With a ``share``, of the rows whose
    ``known`` column is known, and ``train`` tells the first ones of each series (``B.chrono_split``): the panel still has the
    order that this takes, a table read back would be shuffled and sorted for it."""
    panel = with_signal(with_context(daily(spark, sf_dir), spark, sf_dir))
    panel = L.dominance(B.strategy_returns(panel, labels=True), MR, [s for s in STRATEGY_LABELS if s != MR])
    panel = panel.with_df(L.label_daily_winner(panel.df, STRATEGY_LABELS))
    panel = B.features(panel).where(F.expr("macd IS NOT NULL AND rsi IS NOT NULL AND rvol IS NOT NULL AND ret10 IS NOT NULL"))
    panel = panel.roll(
        {
            "next_ret": L.Rolling(lambda w: F.lead("close", 1).over(w) / F.col("close") - 1, ahead=1),
            "next_label": L.shift("best_strategy", -MONTH_ROWS),
        }
    )
    panel = panel.with_columns({"target": F.when(F.col("next_ret").isNotNull(), (F.col("next_ret") > 0).cast("int"))})
    kept = ["symbol", "ts", *M.DIRECTION_FEATURES, "best_strategy", "dominates", "target", "next_label"]
    if share is not None:
        panel = panel.where(F.col(known).isNotNull()) if known else panel
        panel, kept = B.chrono_split(panel, share, gap=gap), [*kept, "train"]
    return cut(panel.select(*kept), "frame")


def _split(spark, sf_dir, share: float = 0.8, known: str | None = None, gap: int = 0):
    table = frame(spark, sf_dir, share, known, gap)
    return _dealt(table.where("train = 1").drop("train")), table.where("train = 0").drop("train")


def _dealt(rows):
    """The library's random numbers depend on where rows are: few enough for it to train on, a series is in one partition and in
    order. More rows stay where they are."""
    if rows.count() > M.LIBRARY_PAIRS // LEAST_TREES:
        return rows
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "symbol").sortWithinPartitions("symbol", "ts")


@query()
def direction_scores(spark, sf_dir):
    """Next-day direction: trained on the first 80 percent of each series, scored on the rest."""
    early, late = _split(spark, sf_dir, known="target")
    model = M.train(early, M.DIRECTION_FEATURES, "target", M.DIRECTION)
    return M.score_direction(late, model, 0.3).select("symbol", "ts", "target", "proba", "signal")


@query()
def direction_scores_short(spark, sf_dir):
    """The same with five features."""
    early, late = _split(spark, sf_dir, known="target")
    model = M.train(early, M.SHORT_FEATURES, "target", M.DIRECTION)
    return M.score_direction(late, model, 0.5).select("symbol", "ts", "target", "proba", "signal")


@query()
def best_strategy_predictions(spark, sf_dir):
    """Best strategy: deep forest on a random 80 percent."""
    rows = frame(spark, sf_dir)
    early = M.hashed_split(rows, ["symbol", "ts"])
    model = M.train(rows.where(early), M.SELECTOR_FEATURES, "best_strategy", M.BEST_STRATEGY)
    return M.predict_strategy(rows.where(~early), model).select("symbol", "ts", "best_strategy", "strategy", "probability")


@query()
def selected_strategies(spark, sf_dir):
    """Strategy selector on a chronological split, saved and loaded before it predicts."""
    early, late = _split(spark, sf_dir)
    path = scratch_path(spark, "selector")
    M.save_model(M.train(early, M.SELECTOR_FEATURES, "best_strategy", M.SELECTOR), path)
    return M.predict_strategy(late, M.load_model(path)).select("symbol", "ts", "best_strategy", "strategy", "probability")


@query()
def dominance_predictions(spark, sf_dir):
    early, late = _split(spark, sf_dir, 0.75)
    model = M.train(early, M.SELECTOR_FEATURES, "dominates", M.DOMINANCE)
    return M.score_direction(late, model, 0.5).select("symbol", "ts", "dominates", "proba", "signal")


@query()
def next_month_predictions(spark, sf_dir):
    """Labels are 21 rows ahead, so the last 21 rows before the cut are not learnt from."""
    early, late = _split(spark, sf_dir, known="next_label", gap=MONTH_ROWS)
    model = M.train(early, M.SELECTOR_FEATURES, "next_label", M.NEXT_MONTH)
    return M.predict_strategy(late, model).select("symbol", "ts", "next_label", "strategy", "probability")


@query()
def feature_importances(spark, sf_dir):
    early, _ = _split(spark, sf_dir, 0.75)
    return M.importances(spark, M.train(early, M.SELECTOR_FEATURES, "dominates", M.DOMINANCE))


# ---------------------------------------------------------------------- what is exact about a model
#
# A forest's numbers depend on its library. Which rows it scores, their labels and what must hold for every score do not.


@query(
    f"""WITH {bars_sql()}, moved AS (SELECT symbol, ts, lead(close) {w()} / close - 1 AS r, row_number() {w()} AS rn FROM bars),
placed AS (SELECT *, row_number() {w()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM moved WHERE rn >= 34 AND r IS NOT NULL)
SELECT symbol, ts, CAST(r > 0 AS INTEGER) AS target, TRUE AS in_bounds, TRUE AS signal_follows FROM placed WHERE i > floor(0.8::DOUBLE * n)"""
)
def direction_scores_exact(spark, sf_dir):
    """Scored rows, their labels, and that each score is a probability and each signal its threshold's."""
    scores = direction_scores(spark, sf_dir)
    bounded = (F.col("proba") >= 0) & (F.col("proba") <= 1)
    follows = (F.col("signal") == 1) == (F.col("proba") > 0.3)
    return scores.select("symbol", "ts", "target", bounded.alias("in_bounds"), follows.alias("signal_follows"))


@query(
    f"""WITH {_RETS}, {_WINNER}, numbered AS (SELECT *, row_number() {w()} AS rn FROM labelled),
placed AS (SELECT *, row_number() {w()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM numbered WHERE rn >= 34)
SELECT symbol, ts, best_strategy, TRUE AS same_strategy, TRUE AS same_probability, TRUE AS known_strategy FROM placed WHERE i > floor(0.8::DOUBLE * n)"""
)
def saved_selector_exact(spark, sf_dir):
    """A strategy selector gives the same predictions after it was saved and loaded."""
    early, late = _split(spark, sf_dir)
    model, path = M.train(early, M.SELECTOR_FEATURES, "best_strategy", M.Forest(20, 5)), scratch_path(spark, "selector")
    M.save_model(model, path)
    first = M.predict_strategy(late, model).select("symbol", "ts", "best_strategy", "strategy", "probability")
    again = M.predict_strategy(late, M.load_model(path)).select("symbol", "ts", F.col("strategy").alias("s"), F.col("probability").alias("p"))
    joined = first.join(again, ["symbol", "ts"])
    return joined.select(
        "symbol",
        "ts",
        "best_strategy",
        (F.col("strategy") == F.col("s")).alias("same_strategy"),
        (F.col("probability") == F.col("p")).alias("same_probability"),
        F.col("strategy").isin(STRATEGY_LABELS).alias("known_strategy"),
    )


def _late_sql(share: float, rows: str) -> str:
    """The rows past the first ``share`` of each series."""
    return f"""placed AS (SELECT *, row_number() {w()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {rows}),
late AS (SELECT * FROM placed WHERE i > floor({share}::DOUBLE * n))"""


_FRAME_SQL = f"{_RETS}, {_WINNER}, numbered AS (SELECT *, row_number() {w()} AS rn, lead(best_strategy, {MONTH_ROWS}) {w()} AS next_label FROM labelled)"


@query(
    f"""WITH {_FRAME_SQL}, {_late_sql(0.75, '(SELECT * FROM numbered WHERE rn >= 34)')}
SELECT symbol, ts, TRUE AS in_bounds, TRUE AS signal_follows, TRUE AS same_proba FROM late"""
)
def dominance_predictions_exact(spark, sf_dir):
    """The scored rows; that scores are probabilities, signals their thresholds', and scores from the node table the model's own."""
    early, late = _split(spark, sf_dir, 0.75)
    model = M.train(early, M.SELECTOR_FEATURES, "dominates", M.DOMINANCE)
    again = M.score_direction(late, M.node_table(spark, model), 0.5).select("symbol", "ts", F.col("proba").alias("p"))
    scores = M.score_direction(late, model, 0.5).join(again, ["symbol", "ts"])
    bounded, follows = F.col("proba").between(0, 1), (F.col("signal") == 1) == (F.col("proba") > 0.5)
    return scores.select("symbol", "ts", bounded.alias("in_bounds"), follows.alias("signal_follows"), (F.col("p") == F.col("proba")).alias("same_proba"))


@query(
    f"""WITH {_FRAME_SQL}, {_late_sql(0.8, '(SELECT * FROM numbered WHERE rn >= 34 AND next_label IS NOT NULL)')}
SELECT symbol, ts, next_label, TRUE AS same_strategy, TRUE AS same_probability, TRUE AS known_strategy FROM late"""
)
def next_month_predictions_exact(spark, sf_dir):
    """The scored rows, their labels, and that the node table predicts what the model does."""
    early, late = _split(spark, sf_dir, known="next_label", gap=MONTH_ROWS)
    model = M.train(early, M.SELECTOR_FEATURES, "next_label", M.NEXT_MONTH)
    again = M.predict_strategy(late, M.node_table(spark, model)).select("symbol", "ts", F.col("strategy").alias("s"), F.col("probability").alias("p"))
    joined = M.predict_strategy(late, model).join(again, ["symbol", "ts"])
    return joined.select(
        "symbol",
        "ts",
        "next_label",
        (F.col("strategy") == F.col("s")).alias("same_strategy"),
        (F.col("probability") == F.col("p")).alias("same_probability"),
        F.col("strategy").isin(STRATEGY_LABELS).alias("known_strategy"),
    )


@query(
    f"""WITH {_FRAME_SQL}, placed AS (SELECT *, row_number() {w()} AS i, count(*) OVER (PARTITION BY symbol) AS n
FROM numbered WHERE rn >= 34 AND next_label IS NOT NULL)
SELECT symbol, ts, CAST(CASE WHEN i <= floor(0.8::DOUBLE * n) - {MONTH_ROWS} THEN 1 WHEN i > floor(0.8::DOUBLE * n) THEN 0 END AS INTEGER) AS train FROM placed"""
)
def purged_split(spark, sf_dir):
    """What the next-month selector learns from: rows whose label lies past the cut belong to neither part."""
    return frame(spark, sf_dir, 0.8, "next_label", MONTH_ROWS).select("symbol", "ts", "train")


@query(
    f"SELECT unnest({list(M.SELECTOR_FEATURES)}) AS feature, TRUE AS in_bounds, TRUE AS falls, TRUE AS whole"
)
def feature_importances_exact(spark, sf_dir):
    """Every feature once; importances are shares of one, the greatest first."""
    ranked = cut(feature_importances(spark, sf_dir).withColumn("place", F.monotonically_increasing_id()), "importances")  # as many rows as features
    ordered = Window.partitionBy(F.lit(1)).orderBy("place")
    falls = F.col("importance") <= F.coalesce(F.lag("importance").over(ordered), F.lit(1.0))
    whole = F.abs(F.sum("importance").over(Window.partitionBy(F.lit(1))) - 1) < 1e-9
    return ranked.select("feature", F.col("importance").between(0, 1).alias("in_bounds"), falls.alias("falls"), whole.alias("whole"))


# ---------------------------------------------------------------------- models traded


def _pooled(rows, share: float = 0.8):
    """Training and scored rows of all series, cut at one date, which is read off once."""
    first_late = F.lit(M.pooled_dates(rows, share).first()["first_late"])
    return rows.where(F.col("ts") < first_late), rows.where(F.col("ts") >= first_late)


@query(
    f"""WITH {bars_sql()}, {VIX_SQL}, dates AS (SELECT DISTINCT ts FROM bars JOIN vix USING (ts)), placed AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i,
count(*) OVER () AS n FROM dates WHERE ts IN (SELECT ts FROM bars QUALIFY row_number() {w()} >= 34)),
cut_at AS (SELECT min(ts) AS ts FROM placed WHERE i >= floor(n * 0.8::DOUBLE))
SELECT symbol, b.ts, CAST(b.ts < c.ts AS INTEGER) AS train FROM (SELECT *, row_number() {w()} AS rn FROM bars) b, cut_at c WHERE rn >= 34"""
)
def pooled_chronological_split(spark, sf_dir):
    """Which rows are learnt from when all series share one cut date."""
    rows = frame(spark, sf_dir)
    return rows.select("symbol", "ts", M.pooled_split(rows).alias("train"))


@query()
def model_backtest(spark, sf_dir):
    """A direction model trained on the early dates of all series; its scores on the later ones become the signal that the
    six strategies trade. Bars before the cut have no score and so no position."""
    early, late = _pooled(frame(spark, sf_dir).where("target IS NOT NULL"))
    model = M.train(early, M.DIRECTION_FEATURES, "target", M.DIRECTION)
    scores = cut(M.score_direction(late, model, 0.3).select("symbol", "ts", "proba", "signal"), "scores")
    panel = daily(spark, sf_dir)
    panel, legs = B.compare(panel.with_df(J.align_signal(panel.df, scores)))
    return rounded(score(panel, legs, "C"))


@query()
def model_switching(spark, sf_dir):
    """A strategy selector trained on the early dates; the later months follow its first confident prediction."""
    early, late = _pooled(frame(spark, sf_dir))
    model = M.train(early, M.SELECTOR_FEATURES, "best_strategy", M.SELECTOR)
    predicted = M.predict_strategy(late, model).select("symbol", "ts", "strategy", "probability")
    wide = returns(spark, sf_dir).select("symbol", "ts", *STRATEGY_LABELS)
    switched = X.switch_monthly(cut(predicted, "predicted"), wide, STRATEGY_LABELS, 0.3)
    return rounded(monthly_metrics(switched, ["symbol"]))


@query(
    f"""WITH {bars_sql()}, {VIX_SQL}, dates AS (SELECT DISTINCT ts FROM bars JOIN vix USING (ts)), placed AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i,
count(*) OVER () AS n FROM dates WHERE ts IN (SELECT ts FROM bars QUALIFY row_number() {w()} >= 34)),
cut_at AS (SELECT min(ts) AS ts FROM placed WHERE i >= floor(n * 0.8::DOUBLE))
SELECT symbol, b.ts, TRUE AS known_strategy, TRUE AS in_bounds FROM (SELECT *, row_number() {w()} AS rn FROM bars) b, cut_at c WHERE rn >= 34 AND b.ts >= c.ts"""
)
def switching_predictions_exact(spark, sf_dir):
    """The predictions that ``model_switching`` follows: which rows have one, that each names a strategy, with a probability that
    at least an even share of the strategies has."""
    early, late = _pooled(frame(spark, sf_dir))
    model = M.train(early, M.SELECTOR_FEATURES, "best_strategy", M.SELECTOR)
    scored = M.predict_strategy(late, model)
    bounded = F.col("probability").between(1 / len(STRATEGY_LABELS) - 1e-9, 1 + 1e-9)
    return scored.select("symbol", "ts", F.col("strategy").isin(STRATEGY_LABELS).alias("known_strategy"), bounded.alias("in_bounds"))


# ---------------------------------------------------------------------- reports


def _judged(spark, sf_dir):
    """Winner against the stand-in prediction."""
    won = winners(spark, sf_dir).select("symbol", "ts", "best_strategy")
    return won.join(predictions(daily(spark, sf_dir)).select("symbol", "ts", "strategy"), ["symbol", "ts"])


_JUDGED = f"{_RETS}, {_WINNER}, {PREDICTIONS_SQL}, judged AS (SELECT l.symbol, l.ts, best_strategy, strategy FROM labelled l JOIN predictions USING (symbol, ts))"


@query(
    f"""WITH {_JUDGED}, classes AS (SELECT c AS class, count(*) FILTER (WHERE best_strategy = c) AS support, count(*) FILTER (WHERE strategy = c) AS chosen,
count(*) FILTER (WHERE best_strategy = c AND strategy = c) AS hits FROM judged, (SELECT unnest({STRATEGY_LABELS}) AS c) GROUP BY c),
rated AS (SELECT *, coalesce(hits / nullif(chosen, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r FROM classes),
scored AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rated)
SELECT class, {q6('p', 'precision')}, {q6('r', 'recall')}, {q6('f', 'f1')}, support FROM scored
UNION ALL SELECT 'accuracy', {q6('sum(hits) / sum(support)', 'a')}, {q6('sum(hits) / sum(support)', 'b')}, {q6('sum(hits) / sum(support)', 'c')},
CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'macro avg', {q6('avg(p)', 'a')}, {q6('avg(r)', 'b')}, {q6('avg(f)', 'c')}, CAST(sum(support) AS BIGINT) FROM scored
UNION ALL SELECT 'weighted avg', {q6('sum(p * support) / sum(support)', 'a')}, {q6('sum(r * support) / sum(support)', 'b')},
{q6('sum(f * support) / sum(support)', 'c')}, CAST(sum(support) AS BIGINT) FROM scored"""
)
def prediction_report(spark, sf_dir):
    return rounded(M.classification_report(_judged(spark, sf_dir), "best_strategy", "strategy"))


@query(
    f"WITH {_JUDGED} SELECT best_strategy AS actual, "
    + ", ".join(f"count(*) FILTER (WHERE strategy = '{s}') AS {s}" for s in STRATEGY_LABELS)
    + " FROM judged GROUP BY 1"
)
def prediction_confusion(spark, sf_dir):
    return M.confusion_matrix(_judged(spark, sf_dir), "best_strategy", "strategy", STRATEGY_LABELS)


@query(
    f"""WITH {bars_sql()}, ahead AS (SELECT {PROBA} AS p, lead(close) {w()} / close - 1 AS r FROM bars),
grid AS (SELECT CAST(t AS DOUBLE) AS threshold FROM (VALUES {', '.join(f'({t})' for t in THRESHOLDS)}) AS v(t)),
counted AS (SELECT threshold, count(*) FILTER (WHERE p > threshold) AS chosen, count(*) FILTER (WHERE p > threshold AND r > 0) AS hits,
  count(*) FILTER (WHERE r > 0) AS positives FROM ahead, grid WHERE r IS NOT NULL GROUP BY 1),
rated AS (SELECT threshold, coalesce(hits / nullif(chosen, 0), 0) AS a, coalesce(hits / nullif(positives, 0), 0) AS b FROM counted)
SELECT threshold, {q6('a', '"precision"')}, {q6('b', 'recall')}, {q6('coalesce(2 * a * b / nullif(a + b, 0), 0)', 'f1')} FROM rated"""
)
def signal_thresholds(spark, sf_dir):
    """Quality of the stand-in probability at eight thresholds."""
    panel = L.label_direction(with_signal(daily(spark, sf_dir)))
    return rounded(M.threshold_sweep(panel.df, "target", "proba", THRESHOLDS), "threshold")
