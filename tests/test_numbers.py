from __future__ import annotations

import random

from pyspark.sql import functions as F

from cinderlog.functions.numbers import rounded


def test_rounds_as_the_exact_value_says(spark):
    """Ties and their neighbours, at three and four decimals, as Python rounds them."""
    rng = random.Random(5)
    values = [0.6665, 0.5785, 0.53375, 1 - 800 / 3296, 0.0, -0.00005, -0.6665, 0.5, 1.0, 2.5, 123456.78945, 1e18, 0.125, 0.0625, 0.00025]
    for d in (3, 4):
        for _ in range(2000):
            m = (2 * rng.randrange(10**d) + 1) / (2 * 10**d)
            values += [m, m * (1 + 2**-52), m * (1 - 2**-53)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for r in df.select("x", rounded(F.col("x"), 3).alias("a"), rounded(F.col("x"), 4).alias("b")).collect():
        assert (r.a, r.b) == (round(r.x, 3), round(r.x, 4)), r.x
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), 3).alias("x")).first().x is None
