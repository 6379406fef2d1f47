import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from numweave.config import NumberFormat, check_decade_layout, codebook, period_list
from numweave.functions import vector as V
from numweave.operators import decode as D
from numweave.operators import encode as E


@pytest.mark.parametrize("bases,i,f,n", [((2, 5), 5, 5, 22), ((10,), 10, 0, 10), ((2, 5, 10), 10, 0, 32),
                                         ((5,), 10, 0, 11), ((7,), 10, 0, 11)])
def test_period_list_sizes(bases, i, f, n):
    assert len(period_list(bases, i, f)) == n


def test_decade_layout_validation():
    check_decade_layout((2, 5, 10))
    with pytest.raises(ValueError):
        check_decade_layout((1, 10))


def test_periodic_features_and_zero_mask(spark):
    fmt = NumberFormat(int_len=2, frac_len=1, bases=(2.0, 5.0), dim=16)
    df = spark.createDataFrame([(0.0,), (1.0,), (12.5,)], "x double")
    out = [r.vector for r in E.encode_periodic(df, "x", fmt).collect()]
    assert out[0] == [0.0] * 16
    for x, vec in zip((1.0, 12.5), out[1:]):
        want = []
        for p in fmt.periods:
            want += [math.cos(x * 2 * math.pi / p), math.sin(x * 2 * math.pi / p)]
        want += [0.0] * (16 - len(want))
        assert np.allclose(vec, want, atol=1e-12)


def test_shift_multiplies_by_power_of_ten(spark):
    fmt = NumberFormat(int_len=3, frac_len=0, bases=(10.0,), dim=8)
    df = spark.createDataFrame([(1.5, 1)], "x double, g int")
    a = E.encode_periodic(df, "x", fmt, shift="g").first().vector
    b = E.encode_periodic(df.withColumn("x", F.lit(15.0)), "x", fmt).first().vector
    assert np.allclose(a, b)


def _clean_vector(x, bases, n_digits, dim):
    cb = codebook(bases)
    out = []
    for k in range(n_digits):
        dgt = (x // 10 ** k) % 10
        out += [cb[m][dgt] for m in range(2 * len(bases))]
    return out + [0.0] * (dim - len(out))


@pytest.mark.parametrize("bases", [(10.0,), (2.0, 5.0), (2.0, 5.0, 10.0)])
@pytest.mark.parametrize("normalize", [False, True])
def test_decode_inverts_codebook_vectors(spark, bases, normalize):
    fmt = NumberFormat(int_len=3, frac_len=0, bases=bases, dim=64)
    rows = [(x, _clean_vector(x, bases, 3, 64)) for x in range(1000)]
    df = spark.createDataFrame(rows, "x int, h array<double>")
    out = D.decode_periodic(df, "h", fmt, normalize=normalize).collect()
    assert all(r.prediction == float(r.x) for r in out)


def test_decode_digits_and_rms(spark):
    fmt = NumberFormat(int_len=2, frac_len=1, bases=(10.0,), dim=8)
    df = spark.createDataFrame([(0, [7.2, 3.0, 1.0, 9.0], 13.7)], "batch_id int, h array<double>, label double")
    assert D.decode_digits(df, "h", fmt).first().prediction == pytest.approx(13.7)
    loss = D.loss_digit_rms(df, "h", "label", fmt).first().loss
    scaled = int(13.7 * 10)
    digits = [(scaled // 10 ** k) % 10 for k in range(3)]
    want = math.sqrt(sum((a - b) ** 2 for a, b in zip([7.2, 3.0, 1.0], digits)) / 3)
    assert loss == pytest.approx(want)


def test_digit_ce_matches_numpy(spark):
    fmt = NumberFormat(int_len=2, frac_len=0, bases=(10.0,), dim=8)
    h = [0.3, -0.2, 0.5, 0.1, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(0, h, 42.0)], "batch_id int, h array<double>, label double")
    got = D.loss_digit_ce(df, "h", "label", fmt).first().loss
    v = np.array(h)
    v = (v - v.mean()) / np.sqrt(v.var() + 1e-5)
    cb = np.array(codebook((10.0,)))
    ce = []
    for k, dgt in enumerate([2, 4]):
        lg = v[2 * k:2 * k + 2] @ cb
        ce.append(np.log(np.exp(lg - lg.max()).sum()) + lg.max() - lg[dgt])
    assert got == pytest.approx(np.mean(ce))


def test_apply_linear_and_layer_norm(spark):
    w = V.rule_matrix(1, 4, 4)
    b = [0.5, 0.0, -0.5, 1.0]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "h array<double>")
    out = E.apply_linear(df, "h", w, b).first().vector
    assert np.allclose(out, np.array(w) @ np.array([1.0, 2.0, 3.0, 4.0]) + np.array(b))
    ln = E.layer_norm(df, "h").first().vector
    v = np.array([1.0, 2.0, 3.0, 4.0])
    assert np.allclose(ln, (v - v.mean()) / np.sqrt(v.var() + 1e-5))


def test_logscale_and_digits_encoders(spark):
    df = spark.createDataFrame([([1.0, 2.0], 0.0), ([1.0, 2.0], 9.0)], "v array<double>, x double")
    out = [r.vector for r in E.encode_logscale(df, "v", "x", 5 / math.log(10.0)).collect()]
    assert out[0] == [1.0, 2.0] and np.allclose(out[1], [5.0, 10.0])
    fmt = NumberFormat(int_len=3, frac_len=2, bases=(10.0,), dim=12)
    d = spark.createDataFrame([(123.45,), (0.0,)], "x double")
    vecs = [r.vector for r in E.encode_digits(d, "x", fmt).collect()]
    scaled = int(123.45 * 100)                          # truncation, as the reference's .long()
    assert vecs[0][:5] == [float((scaled // 10 ** k) % 10) for k in range(5)]
    assert vecs[1] == [0.0] * 12


def test_filter_nonzero_mask(spark):
    df = spark.createDataFrame([(0.0, [1.0, 1.0], None), (0.0, [1.0, 1.0], 3)], "x double, v array<double>, pos int")
    assert [r.v for r in E.filter_nonzero_mask(df, "x", "v").collect()] == [[0.0, 0.0], [0.0, 0.0]]
    assert [r.v for r in E.filter_nonzero_mask(df, "x", "v", position_col="pos").collect()] == [[0.0, 0.0], [1.0, 1.0]]


def test_null_values_encode_as_zero(spark):
    fmt = NumberFormat(int_len=3, frac_len=1, bases=(2.0, 5.0), dim=32)
    df = spark.createDataFrame([(None,), (0.0,), (1.5,)] * 20, "x double")
    vecs = [r.vector for r in E.encode_periodic(df, "x", fmt).collect()]
    assert vecs[0] == vecs[1] == [0.0] * 32 and any(vecs[2])


def test_digits_beyond_bigint(spark):
    from numweave.functions import numeric as N

    fmt = NumberFormat(int_len=16, frac_len=2, bases=(10.0,), dim=64)
    for x in (123456789012345678.0, 4644348398010899.0, 1e300, -5e18, 9.3e18, float("inf"), float("nan"), None):
        df = spark.createDataFrame([(x,)], "x double")
        got = df.select(N.digits_rounded("x", 16, 2), N.digits_truncated("x", 16, 2)).first()
        if x is None or math.isinf(x) or math.isnan(x):
            assert got[0] is None and got[1] is None
            continue
        whole = int(x * 100.0)
        assert got[0] == got[1] == [(whole // 10 ** k) % 10 for k in range(18)]
        assert E.encode_digits(df, "x", fmt).first().vector[:18] == [float(d) for d in got[1]]


def test_bases_are_checked():
    import pytest

    with pytest.raises(ValueError):
        NumberFormat(int_len=3, frac_len=1, bases=(1.0, 10.0), dim=32)
