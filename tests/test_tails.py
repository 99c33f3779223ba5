import math

import pytest

from cohortlab.functions import tails


def test_published_tail_values():
    assert tails.norm_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert tails.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)


def test_published_study_values():
    # likelihood ratio 25.53 on one df, and 5 of 19 against 1 of 43
    assert tails.chi2_upper(25.53, 1) == pytest.approx(4.36e-07, rel=5e-3)
    assert tails.fisher_two_sided(5, 14, 1, 42) == pytest.approx(0.0086, abs=5e-5)


def test_hypergeometric_sums_to_one():
    assert tails.hypergeom_upper(0, 50, 12, 9) == pytest.approx(1.0)
    exact = sum(math.comb(12, i) * math.comb(38, 9 - i) for i in range(4, 10)) / math.comb(50, 9)
    assert tails.hypergeom_upper(4, 50, 12, 9) == pytest.approx(exact, rel=1e-10)


def test_trigamma_inverse_round_trip():
    assert tails.trigamma_inverse(math.pi**2 / 6) == pytest.approx(1.0, rel=1e-9)
    assert tails.trigamma_inverse(math.pi**2 / 2) == pytest.approx(0.5, rel=1e-9)
    assert tails.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)


def test_discrete_tails_equal_full_sums_and_stay_fast():
    import math
    import time

    from cohortlab.functions import tails as t

    choose = math.comb
    for a, b, c, d in [(3, 1, 2, 6), (0, 5, 7, 1), (10, 12, 9, 30), (1, 0, 0, 0), (4, 4, 4, 4), (0, 3, 0, 9)]:
        total, marked, drawn = a + b + c + d, a + b, a + c
        mass = {i: choose(marked, i) * choose(total - marked, drawn - i) / choose(total, drawn) for i in range(max(0, drawn + marked - total), min(marked, drawn) + 1)}
        assert abs(t.fisher_two_sided(a, b, c, d) - min(1.0, sum(p for p in mass.values() if p <= mass[a] * (1 + 1e-7)))) < 1e-12
        for k in range(-1, total + 2):
            assert abs(t.hypergeom_upper(k, total, marked, drawn) - sum(p for i, p in mass.items() if i >= k)) < 1e-12
    start = time.perf_counter()
    assert 0 < t.fisher_two_sided(5e7 + 2e4, 5e7, 5e7, 5e7) < 1
    assert time.perf_counter() - start < 1
