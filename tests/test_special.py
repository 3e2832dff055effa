"""p-values against textbook values."""

import math

from creditlens.functions import special


def test_t_two_sided():
    assert math.isclose(special.t_two_sided_p(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(special.t_two_sided_p(0.0, 5), 1.0, rel_tol=1e-12)
    assert special.t_two_sided_p(80.0, 1_000_000) == 0.0 or special.t_two_sided_p(80.0, 1_000_000) < 1e-300


def test_chi2_sf():
    assert math.isclose(special.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(special.chi2_sf(5.991464547107979, 2), 0.05, rel_tol=1e-9)
    assert math.isclose(special.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert special.chi2_sf(4182.0, 13) < 1e-300


def test_normal_two_sided():
    assert math.isclose(special.norm_two_sided_from_z(1.959963984540054), 0.05, rel_tol=1e-9)
    assert special.norm_two_sided_from_z(0.0) == 1.0
