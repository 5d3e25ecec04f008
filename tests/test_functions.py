import math

import pytest
from pyspark.sql import functions as F

from hitweave.functions import geometry as G
from hitweave.functions import vectors as V
from hitweave.functions.binomial import beta_cdf, clopper_pearson
from hitweave.functions.conditions import all_of, condition, fiducial
from hitweave.functions.inference import Mlp, embed_udf, random_mlp, score_udf


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


def test_wrap_and_slopes(spark):
    got = one(
        spark,
        up=G.wrap_angle(F.lit(4.0)),
        down=G.wrap_angle(F.lit(-4.0)),
        at_pi=G.wrap_angle(F.lit(math.pi)),
        zero_zero=G.safe_slope(F.lit(0.0), F.lit(0.0)),
        plus=G.safe_slope(F.lit(1.0), F.lit(0.0)),
        minus=G.safe_slope(F.lit(-1.0), F.lit(0.0)),
        clamped=G.safe_slope(F.lit(1.0), F.lit(0.001)),
        plain=G.safe_slope(F.lit(1.0), F.lit(4.0)),
    )
    assert got["up"] == pytest.approx(4 - 2 * math.pi)
    assert got["down"] == pytest.approx(2 * math.pi - 4)
    assert got["at_pi"] == math.pi
    assert (got["zero_zero"], got["plus"], got["minus"], got["clamped"], got["plain"]) == (0, 100, -100, 100, 0.25)


def test_eta_and_kinematics(spark):
    got = one(spark, eta=G.pseudorapidity(F.lit(1.0), F.lit(1.0)), pe=G.particle_eta(F.lit(3.0), F.lit(4.0)),
              prim=G.primary_flag(F.lit(199999)), sec=G.primary_flag(F.lit(200000)))
    assert got["eta"] == pytest.approx(-math.log(math.tan(math.pi / 8)))
    assert got["pe"] == pytest.approx(math.atanh(0.8))
    assert (got["prim"], got["sec"]) == (1, 0)


def test_schedule(spark):
    e = lambda x: F.lit(x)
    got = one(spark, one_=G.schedule(0.3, e(5), 10), two=G.schedule([0.0, 1.0], e(5), 10),
              three=G.schedule([0.0, 1.0, 0.0], e(7.5), 10), k=G.schedule([1, 4], e(5), 10, integer=True))
    assert (got["one_"], got["two"], got["three"], got["k"]) == (0.3, 0.5, 0.5, 2)
    with pytest.raises(ValueError):
        G.schedule([1, 2, 3, 4], e(1), 10)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    got = one(spark, d=V.squared_distance(a, b), n=V.l2_normalise(a), z=V.l2_normalise(b),
              m=V.zero_if_missing(F.lit(float("nan"))))
    assert got["d"] == 25 and got["n"] == pytest.approx([0.6, 0.8]) and got["z"] == [0, 0] and got["m"] == 0


def test_conditions_and_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 1.0, True, 11), (2, 5.0, False, 22), (3, None, None, None), (4, float("nan"), True, 11)],
        "id int, pt double, flag boolean, pdg int",
    )
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(condition("pt", [1.0, float("inf")])) == [1, 2]
    assert ids(condition("flag", True)) == [1, 4]
    assert ids(condition("pdg", ["in", [11]])) == [1, 4]
    assert ids(condition("pdg", ["not_in", [11]])) == [2]
    assert ids(condition("pt", ["not_within", [0.0, 2.0]])) == [2, 4]
    assert ids(all_of({"pt": [0.0, 2.0], "flag": True})) == [1]
    # a missing value passes the exclusion, but neither "at least" nor a range
    assert ids(fiducial({"pdg": ["not_in", [11]]})) == [2, 3]
    assert ids(fiducial({"pt": 2.0})) == [2]
    assert ids(fiducial({"pt": [0.0, 9.0]})) == [1, 2]
    for bad in ({"pt": 1.0}, {"pt": ["odd", 1]}):
        with pytest.raises(ValueError):
            all_of(bad)


def test_clopper_pearson_known_values():
    # No success in n trials: the upper bound is 1 - alpha^(1/n) in closed form.
    alpha = 0.16
    low, high = clopper_pearson([0, 10, 5], [10, 10, 10])
    assert low[0] == 0 and high[0] == pytest.approx(1 - alpha ** (1 / 10), abs=1e-9)
    assert high[1] == 0 and low[1] == pytest.approx(1 - alpha ** (1 / 10), abs=1e-9)
    assert low[2] == pytest.approx(high[2], abs=1e-9)
    assert math.isnan(clopper_pearson([0], [0])[0][0])
    # I_x(2, 3) = 6x^2 - 8x^3 + 3x^4
    x = 0.3
    assert beta_cdf([2.0], [3.0], [x])[0] == pytest.approx(6 * x**2 - 8 * x**3 + 3 * x**4)


def test_networks(spark):
    import numpy as np

    net = random_mlp([2, 4, 3], seed=1, hidden="relu", output="tanh", layer_norm=True)
    df = spark.createDataFrame([([1.0, 2.0],), ([0.5, -1.0],)], "v array<double>")
    got = [r.e for r in df.select(embed_udf(net)("v").alias("e")).collect()]
    assert np.allclose(got, net(np.array([[1.0, 2.0], [0.5, -1.0]])))
    line = Mlp((((np.array([[1.0], [2.0]])), np.array([0.5])),))
    assert [r[0] for r in df.select(score_udf(line)("v")).collect()] == [5.5, -1.0]
