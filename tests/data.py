"""Small seeded panels for tests."""

import datetime as dt
import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("ts", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("vix", T.DoubleType()),
    ]
)


def random_bars(spark, sizes=(300, 37, 1), seed=7, gap=0.3, start=dt.date(2020, 1, 1)):
    """Random walks with calendar gaps; one long series, one short, one of a single bar."""
    rng = random.Random(seed)
    rows = []
    for i, size in enumerate(sizes):
        price, day = 100.0, start
        for _ in range(size):
            previous = price
            price = max(20.0, price + rng.randint(-200, 200) / 64)
            high, low = max(price, previous) + rng.randint(0, 80) / 64, min(price, previous) - rng.randint(0, 80) / 64
            rows.append((f"s{i}", day, previous, high, low, price, rng.randint(1, 400), 10 + rng.randint(0, 60) / 4))
            day += dt.timedelta(days=1 + (rng.randint(1, 9) if rng.random() < gap else 0))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)
