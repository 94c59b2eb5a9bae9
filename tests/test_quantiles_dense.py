"""Many quantiles at once equal the few, by a plan that does not grow with them."""

import random

import pytest
from pyspark.sql import functions as F

from somnolyt.operators import quantiles
from somnolyt.operators.quantiles import column_quantiles, dense_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    draw = [lambda: r.gauss(0, 1), lambda: float(r.randrange(3)), lambda: r.expovariate(1) ** 8]
    return spark.createDataFrame([(None if r.random() < 0.1 else draw[i % 3](),) for i in range(3000)], "v double").repartition(5)


@pytest.mark.parametrize("accuracy", [10_000, 50, 20])
def test_many_quantiles_equal_the_few(rows, accuracy):
    cols = {"v": F.col("v"), "a.b": F.col("v") * 2, "none": F.lit(None).cast("double"), "one": F.lit(7.0),
            "nan": F.when(F.col("v") > 0.5, float("nan")).otherwise(F.col("v"))}
    both = rows.select(*[x.alias(c) for c, x in cols.items()])
    probs = [i / 64 for i in range(65)]
    got = dense_quantiles(both, list(cols), probs, accuracy)
    plain = both.withColumnRenamed("a.b", "ab")
    want = column_quantiles(plain, ["v", "ab", "none", "one", "nan"], probs, accuracy)
    for c in cols:
        assert str(got[c]) == str(want[c.replace(".", "")]), c


def test_many_quantiles_have_a_plan_of_their_own_size(rows, monkeypatch):
    """The plan does not grow with the probabilities (before: 130 aggregates and chains of 65 tests)."""
    plans = []
    taken = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or taken(df))
    for k in (4, 64):
        dense_quantiles(rows, ["v"], [i / k for i in range(k + 1)], 50)
    assert len(plans[0]) == pytest.approx(len(plans[1]), rel=0.1)
