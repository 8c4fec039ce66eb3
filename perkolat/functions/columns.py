"""Column functions: distances, thresholds, intervals, guards. Null in, null out; NaN and infinities count as null."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: The honeycomb bond threshold and that of the square lattice.
P_HONEYCOMB, P_SQUARE = 1 - 2 * math.sin(math.pi / 18), 0.5


def finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))))


def cebh(k1: Column, k2: Column) -> Column:
    """The degree-moment threshold <k> / (<k2> - <k>), null where the denominator is not positive."""
    return F.when(k2 - k1 > 0, k1 / (k2 - k1))


def effective_dimension(pc: Column, k1: Column) -> Column:
    r = pc * k1
    return F.when(r > 1, r / (r - 1))


def junction_anchor(n3: Column, n4: Column) -> Column:
    return F.when(n3 + n4 > 0, (n3 * P_HONEYCOMB + n4 * P_SQUARE) / (n3 + n4))


def meshedness(n: Column, m: Column) -> Column:
    return F.when(2 * n - 5 > 0, (m - n + 1) / (2 * n - 5))


def euler_slack(n: Column, m: Column) -> Column:
    return F.when(3 * n - 6 > 0, m / (3 * n - 6))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-12, a / b)


def is_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def mean_ci(c: Column) -> list[Column]:
    """Aggregates n, mean, ci_low, ci_high: mean +- 1.96 s / sqrt(n); one value gives a point, none nulls."""
    x = finite(c)
    half = F.when(F.count(x) > 1, 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))).when(F.count(x) == 1, 0.0)
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), (F.avg(x) - half).alias("ci_low"), (F.avg(x) + half).alias("ci_high")]


def share(cond: Column) -> Column:
    """Aggregate: share of rows where cond holds; null counts as false and stays in the denominator."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def ratio_of_sums(a: Column, b: Column) -> Column:
    return F.sum(a) / F.greatest(F.sum(b), F.lit(1))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def accents() -> tuple[str, str]:
    """Letters with marks up to U+1EFF, and the plain letters that their decompositions begin with: the table is made by that rule."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Words of administration that are no part of a place's name.
ADMINISTRATIVE = "city|municipality|metropolitan|area|greater|province|prefecture|district"


def normalised_name(c: Column) -> Column:
    """Lower case, marks off letters, punctuation to spaces, administrative words dropped, spaces collapsed."""
    plain = F.regexp_replace(F.translate(F.lower(c), *accents()), r"\p{M}", "")
    spaced = F.regexp_replace(plain, r"[,._/\-()'’]", " ")
    dropped = F.regexp_replace(spaced, rf"\b({ADMINISTRATIVE})\b", " ")
    return F.trim(F.regexp_replace(dropped, r"\s+", " "))


def position_seed(c: Column) -> Column:
    """Sum over places i from 1 of i times the code point there, in lower case."""
    chars = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    return F.aggregate(F.transform(chars, lambda x, i: (i + 1).cast("long") * F.ascii(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def divided_if_set(a: Column, b: Column) -> Column:
    """a / b where b is neither zero nor null."""
    return F.when(b != 0, a / b)


def divided_if_positive(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def log10_positive(c: Column) -> Column:
    """log10 of positive values, else null."""
    return F.when(c > 0, F.log10(c))


def clipped(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c held between the bounds given; null stays null."""
    out = c if low is None else F.when(c.isNotNull(), F.greatest(c, F.lit(low)))
    return out if high is None else F.when(c.isNotNull(), F.least(out, F.lit(high)))


def truthy_tag(c: Column) -> Column:
    """Whether a tag, or the joined items of a list of tags, is set to anything but no, false, none, 0, nan or nothing."""
    v = F.lower(F.trim(c))
    return F.coalesce(~v.isin("", "no", "false", "none", "0", "nan"), F.lit(False))


def proper_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the segments ab and cd cross in an inner point of both: touching and collinear overlap do not count."""

    def side(px, py, qx, qy, rx, ry):
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
