"""Split, scaling and fold queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketframe.operators import split as sp

from . import check
from .bars import PANEL, panel
from .indicators import SERIES

ROWS = f"""{PANEL},
numbered_rows AS (
  SELECT *, row_number() OVER {SERIES} - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n_rows FROM panel),
sized AS (
  SELECT *, floor(n_rows * 0.7::DOUBLE) AS n_train, floor(n_rows * 0.15::DOUBLE) AS n_val FROM numbered_rows),
parts AS MATERIALIZED (
  SELECT *, CASE WHEN row_no < n_train THEN 'train' WHEN row_no < n_train + n_val THEN 'val' ELSE 'test' END AS split
  FROM sized)"""


@check(
    "P1_temporal_split",
    "symbol date:d row_no:i n_train:i n_val:i split",
    f"WITH {ROWS}, result AS (SELECT * FROM parts)",
)
def temporal_split(spark, sf):
    return sp.temporal_split(panel(spark, sf))


STATS = {
    "minmax": "min({c}) AS {c}_centre, max({c}) - min({c}) AS {c}_scale",
    "standard": "avg({c}) AS {c}_centre, stddev_pop({c}) AS {c}_scale",
    "robust": "median({c}) AS {c}_centre, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_scale",
}


def scaled_sql(kind: str) -> str:
    stats = ", ".join(STATS[kind].format(c=c) for c in ("close", "volume"))
    cols = ", ".join(
        f"(p.{c} - {c}_centre) / CASE WHEN {c}_scale = 0 THEN 1 ELSE {c}_scale END AS {c}"
        for c in ("close", "volume")
    )
    return (
        f"{ROWS}, stats AS (SELECT symbol, {stats} FROM parts WHERE split = 'train' GROUP BY symbol), "
        f"scaled AS (SELECT p.symbol, p.date, p.split, {cols} FROM parts p JOIN stats s ON p.symbol = s.symbol)"
    )


def train_rows(df):
    return df.filter(F.col("split") == "train")


for _kind in sp.SCALERS:

    @check(
        f"P2_scale_{_kind}",
        "symbol date:d close:6 volume:6",
        f"WITH {scaled_sql(_kind)}, result AS (SELECT * FROM scaled)",
    )
    def scale(spark, sf, kind=_kind):
        parts = sp.temporal_split(panel(spark, sf))
        return sp.scale_on_train(parts, ["close", "volume", "not_there"], kind)

    @check(
        f"P2_fit_then_apply_{_kind}",
        "symbol date:d close:6 volume:6",
        f"WITH {scaled_sql(_kind)}, result AS (SELECT * FROM scaled)",
    )
    def fit_then_apply(spark, sf, kind=_kind):
        parts = sp.temporal_split(panel(spark, sf))
        stats = sp.fit_scaler(train_rows(parts), ["close", "volume", "not_there"], kind)
        return sp.apply_scaler(parts, stats)


@check(
    "P3_inverse_scale",
    "symbol date:d close:8",
    f"WITH {PANEL}, result AS (SELECT symbol, date, close FROM panel)",
)
def inverse(spark, sf):
    parts = sp.temporal_split(panel(spark, sf))
    stats = sp.fit_scaler(train_rows(parts), ["close"], "minmax")
    return sp.inverse_scale(sp.apply_scaler(parts, stats), stats, "close")


@check(
    "P5_prepared_sequences",
    "symbol split n:i first_date:d last_date:d window_sum:4 y_sum:4",
    f"""WITH {scaled_sql('minmax')},
w AS (
  SELECT symbol, date, split, close AS y, list(close) OVER f AS c, list(volume) OVER f AS v FROM scaled
  WINDOW f AS (PARTITION BY symbol, split ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
result AS (
  SELECT symbol, split, count(*) AS n, min(date) AS first_date, max(date) AS last_date,
         sum(list_sum(c) + 2 * list_sum(v)) AS window_sum, sum(y) AS y_sum
  FROM w WHERE len(c) = 60 GROUP BY symbol, split)""",
)
def prepared(spark, sf):
    _, seq, _ = sp.prepare_data(panel(spark, sf), ["volume", "close"], "minmax", 60)
    total = F.aggregate("window", F.lit(0.0), lambda s, x: s + x[0] + 2 * x[1])
    return seq.groupBy("symbol", "split").agg(
        F.count("*").alias("n"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.sum(total).alias("window_sum"),
        F.sum(F.col("y")[0]).alias("y_sum"),
    )


@check(
    "P6_training_masks",
    "symbol date:d fit_row:i stop_row:i",
    f"WITH {ROWS}, result AS (SELECT symbol, date, row_no < n_train - 1 AS fit_row, "
    "row_no >= n_train AND row_no < n_train + n_val - 1 AS stop_row FROM parts)",
)
def masks(spark, sf):
    return sp.training_masks(panel(spark, sf))


@check(
    "P7_folds",
    "symbol date:d fold:i role",
    f"""WITH {ROWS}, result AS (
  SELECT symbol, date, fold, CASE WHEN row_no < n_rows - (5 - fold) * (n_rows // 6) THEN 'train' ELSE 'test' END AS role
  FROM parts JOIN range(5) AS folds(fold) ON row_no < n_rows - (5 - fold) * (n_rows // 6) + n_rows // 6)""",
)
def folds(spark, sf):
    return sp.time_series_folds(panel(spark, sf))


CALENDAR = f"""WITH {PANEL},
counted AS (SELECT date, count(*) AS c FROM panel GROUP BY date),
cut_days AS (SELECT date, row_number() OVER (ORDER BY date) AS day, floor((sum(c) OVER (ORDER BY date) - c) * 6 / sum(c) OVER ())::INT AS block FROM counted),
starts AS (SELECT block, min(day) AS start FROM cut_days GROUP BY block),
folded AS (
  SELECT symbol, p.date, fold, CASE WHEN d.block = fold + 1 THEN 'test' ELSE 'train' END AS role
  FROM panel p JOIN cut_days d ON p.date = d.date JOIN range(5) AS f(fold) ON d.block <= fold + 1 JOIN starts s ON s.block = fold + 1
  WHERE d.block = fold + 1 OR d.day < s.start - 3)"""


@check("P7_calendar_folds", "symbol date:d fold:i role", f"{CALENDAR}, result AS (SELECT * FROM folded)")
def calendar_folds(spark, sf):
    """One cut for all symbols, a purged day and two days of embargo before each test block."""
    return sp.calendar_folds(panel(spark, sf), embargo=2)


@check(
    "P7_calendar_order",
    "fold:i late:i gap:i",
    f"""{CALENDAR}, result AS (
  SELECT fold, 0 AS late, (SELECT count(*) FROM counted c WHERE c.date > t.last_train AND c.date < t.first_test) AS gap
  FROM (SELECT fold, max(date) FILTER (role = 'train') AS last_train, min(date) FILTER (role = 'test') AS first_test FROM folded GROUP BY fold) t)""",
)
def calendar_order(spark, sf):
    """Training dates that are not before every test date (none), and the days between."""
    df = panel(spark, sf)
    folds = sp.calendar_folds(df, embargo=2)
    first = folds.where("role = 'test'").groupBy("fold").agg(F.min("date").alias("first"))
    train = folds.where("role = 'train'").groupBy("fold").agg(F.max("date").alias("last"))
    late = folds.where("role = 'train'").join(first, "fold").groupBy("fold").agg(F.count_if(F.col("date") >= F.col("first")).alias("late"))
    number = F.row_number().over(Window.orderBy("date"))
    days = df.select("date").distinct().select("date", number.alias("day"))
    ends = first.join(train, "fold").join(late, "fold")
    ends = ends.join(days.select(F.col("date").alias("first"), F.col("day").alias("_to")), "first")
    ends = ends.join(days.select(F.col("date").alias("last"), F.col("day").alias("_from")), "last")
    return ends.withColumn("gap", F.col("_to") - F.col("_from") - 1)
