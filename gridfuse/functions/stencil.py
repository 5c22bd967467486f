"""Formulas of the fusion, as expressions over one cell and one neighbour."""

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-7

#: Products of differences are summed in two parts, of the bits above and below this one.
LIMB_BITS = 16


def limbs(x, y) -> tuple[Column, Column]:
    """The product of two differences of int cells, in parts whose sums fit a bigint."""
    return F.shiftright(x, LIMB_BITS) * y, x.bitwiseAND(F.lit(2**LIMB_BITS - 1)) * y


def from_limbs(high, low) -> Column:
    """The sum of products from the sums of their parts, exactly."""
    return high.cast("decimal(20,0)") * F.lit(2**LIMB_BITS) + low.cast("decimal(20,0)")


def is_similar(t1, t2, centre1, centre2, near1, near2) -> Column:
    """Both cells have data at both dates and differ by at most the thresholds."""
    centre1, centre2 = centre1.cast("bigint"), centre2.cast("bigint")
    has_data = (centre1 != 0) & (centre2 != 0) & (near1 != 0) & (near2 != 0)
    return has_data & (F.abs(centre1 - near1) <= t1) & (F.abs(centre2 - near2) <= t2)


def correlation(fine1, fine2, coarse1, coarse2) -> Column:
    """Pearson correlation of the pairs (fine1, coarse1) and (fine2, coarse2).

    With two points that is the sign of the product of the differences; where
    it is undefined it counts as 0.
    """
    fine, coarse = fine1.cast("bigint") - fine2, coarse1.cast("bigint") - coarse2
    return F.signum(fine.cast("double")) * F.signum(coarse.cast("double"))


def distance(dr, dc, window: int) -> Column:
    """1 plus the straight distance in units of half a window."""
    return 1 + F.sqrt((dr * dr + dc * dc).cast("double")) / (window // 2)


def combined_distance(corr, dist) -> Column:
    """Small for a near and well correlated neighbour; never 0."""
    return (1 - corr + EPSILON) * dist


def slope(n, sx, sy, sxy, sxx) -> Column:
    """Least-squares slope from integer sums, 1 where it is undefined.

    The sums may be of values relative to any fixed point.
    """
    sx, sy = sx.cast("decimal(20,0)"), sy.cast("decimal(20,0)")
    spread = n * sxx - sx * sx
    rise = (n * sxy - sx * sy).cast("double")
    return F.when(spread != 0, rise / spread.cast("double")).otherwise(F.lit(1.0))


def temporal_weight_m(tp, tkm, tkn, zero_change: str = "limit") -> Column:
    """Weight of date m: inverse to its coarse change, relative to both dates.

    ``limit`` takes the limit where a change is 0; ``zero`` gives 0 there.
    """
    to_m, to_n = F.abs(tkm - tp), F.abs(tkn - tp)
    share = F.when(to_m + to_n == 0, 0.5).otherwise(F.try_divide(to_n, to_m + to_n))
    return _still_is_zero(share, to_m, to_n, zero_change)


def temporal_weight_n(tp, tkm, tkn, zero_change: str = "limit") -> Column:
    to_m, to_n = F.abs(tkm - tp), F.abs(tkn - tp)
    share = 1 - temporal_weight_m(tp, tkm, tkn)
    return _still_is_zero(share, to_m, to_n, zero_change)


def _still_is_zero(share, to_m, to_n, zero_change) -> Column:
    if zero_change == "limit":
        return share
    if zero_change == "zero":
        return F.when((to_m == 0) | (to_n == 0), 0.0).otherwise(share)
    raise ValueError(f"unknown zero_change {zero_change!r}")
