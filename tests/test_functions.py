import math
import random

import numpy as np
from pyspark.sql import functions as F

from clusterloom.functions import stats
from clusterloom.functions import text as T
from clusterloom.functions.vectors import dot, normalized


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_vectors(spark):
    assert one(spark, "a array<float>, b array<float>", ([1.0, 2.0], [3.0, 4.0]), dot(F.col("a"), F.col("b"))) == (11.0,)
    assert one(spark, "a array<float>, b array<float>", ([3.0, 4.0], [0.0, 0.0]), normalized(F.col("a")), normalized(F.col("b"))) == ([0.6, 0.8], [0.0, 0.0])


def test_texts(spark):
    row = (" Été  is here\nnow ", "a b c", "", None)
    got = one(spark, "a string, b string, c string, d string", row, T.word_count(F.col("a")), T.tokens(F.col("a")), T.truncated(F.col("b"), 3), T.truncated(F.col("b"), 2), T.is_not_blank(F.col("c")), T.cleaned_label(F.col("d")), T.cleaned_label(F.col("a")))
    assert got == (4, ["été", "is", "here", "now"], "a b c", "a b...", False, T.NO_LABEL, "Été  is here\nnow")


def test_waits(spark):
    for message, seconds in (("try again in 7.5s", 7.5), ("try again in 1m30s", 90.0), ("other", 60.0)):
        assert one(spark, "m string", (message,), T.wait_seconds(F.col("m"))) == (seconds,)


def test_token_f1(spark):
    cases = [("sci.med", "Med Sci", 1.0), ("age_limit", "limit", 2 / 3), ("Sci/Tech", "tech", 0.0), (".", "x", 0.0), ("a", "", 0.0), ("a b", "b b c", 0.5)]
    for truth, generated, want in cases:
        assert math.isclose(one(spark, "t string, g string", (truth, generated), T.token_f1(F.col("t"), F.col("g")))[0], want)


def test_p_values(spark):
    # Published values of the t distribution: t = r * sqrt(nu / (1 - r^2)).
    rows = [(0.281, 5, 0.6468), (-0.625, 5, 0.2592), (0.1, 5, 0.8729), (0.392, 77, 0.0004), (1.0, 9, 0.0), (0.0, 4, 1.0), (0.5, 3, 2 / 3)]
    for r, n, p in rows:
        got = one(spark, "r double, n long", (r, n), stats.p_value(F.col("r"), F.col("n")))[0]
        assert abs(got - p) < 6e-4, (r, n, got)
    assert one(spark, "r double, n long", (0.5, 2), stats.p_value(F.col("r"), F.col("n"))) == (None,)


def test_correlations_against_numpy(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(40)] + [("b", 1.0, float(i)) for i in range(5)] + [("c", 1.0, 2.0), ("c", 2.0, 1.0)] + [("a", None, 1.0)]
    got = stats.correlations(spark.createDataFrame(rows, "g string, x double, y double"), ["g"]).collect()
    assert [r["g"] for r in got] == ["a"] and got[0]["n"] == 40
    x, y = (np.array([r[k] for r in rows[:40]]) for k in (1, 2))
    ranks = lambda v: np.array([(v < z).sum() + ((v == z).sum() + 1) / 2 for z in v])
    assert abs(got[0]["pearson_r"] - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert abs(got[0]["spearman_r"] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-12


def test_min_max_and_ideal(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 2.0, None)], "g string, x double, y double")
    got = sorted(map(tuple, stats.min_max(df, ["g"], ["x", "y"]).collect()))
    assert got == [("a", 0.0, 0.5), ("a", 1.0, 0.5), ("b", 0.5, None)]
    assert one(spark, "m long", (4,), stats.ideal_reciprocal(F.col("m")))[0] == (1 + 1 / 2 + 1 / 3) / 3
