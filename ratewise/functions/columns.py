"""Column-expression helpers (all JVM-side, no Python UDFs).

Each helper returns a ``Column`` so it composes into one projection and
stays inside whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's for the same results) --------
# Month and weekday labels, Monday first (Monday = 0).
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_ABBR = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
# Lead-time buckets: upper bounds in days, the last one open.
LEAD_BUCKETS = [(3, "Last_Minute"), (14, "Short_Term"), (60, "Medium_Term")]
LEAD_BUCKET_LAST = "Long_Term"
LEAD_BUCKET_ORDER = ["Last_Minute", "Short_Term", "Medium_Term", "Long_Term"]
# Occupancy bands: right-closed, lowest edge excluded.
OCC_BAND_EDGES = [0, 0.5, 0.65, 0.75, 0.85, 0.95, 1.01]
OCC_BAND_LABELS = ["<50%", "50–65%", "65–75%", "75–85%", "85–95%", ">95%"]
# Event magnitude (0..5) to estimated premium.
EVENT_PREMIUM = {0: 0.0, 1: 0.10, 2: 0.25, 3: 0.45, 4: 0.60, 5: 0.80}
# ---------------------------------------------------------------------------


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Rounding halves away from zero is decided in a decimal; farther than this from a half
# (in units of the last place kept, up to 1e11 of them) doubles give the same value.
HALF_MARGIN = 0.02
EXACT_UNITS = 1e11


def _half_up(x: Column, n: int, kind: str = "decimal(18,8)") -> Column:
    """``x`` through the decimal type ``kind``, rounded half-up to ``n`` places, as a double.

    Decimals are slow (Spark reads them from the double's text), so they only
    decide what lies close to a half, is large, or is no number.
    """
    slow = F.round(x.cast(kind), n).cast("double")
    if not 0 <= n <= 6:
        return slow
    unit = float(10 ** n)
    y = x.cast("double") * F.lit(unit)
    low = F.floor(y)
    clear = (F.abs(y) < EXACT_UNITS) & (F.abs(y - low - 0.5) > HALF_MARGIN)
    return F.when(clear, F.floor(y + 0.5).cast("double") / F.lit(unit)).otherwise(slow)


def rnd(x: str | Column, n: int = 2) -> Column:
    """Round half-up through decimal(18,8), as the table build specifies.

    Going through a decimal first makes Spark and DuckDB agree on values
    that sit on a binary rounding edge.
    """
    return _half_up(c(x), n)


def fin(x: str | Column, n: int = 6) -> Column:
    """Round a result column for comparison (wide decimal, no overflow)."""
    return F.round(c(x).cast("decimal(38,12)"), n).cast("double")


def fin_row(x: str | Column, n: int = 6) -> Column:
    """``fin`` for columns of rows, not of aggregates: a decimal that fits a
    long, so rounding a table costs little. Values must stay under 1e10."""
    return _half_up(c(x), n)


def fin_wide_row(x: str | Column, n: int = 6) -> Column:
    """``fin`` itself for columns of rows: the same values at a fraction of the cost."""
    return _half_up(c(x), n, "decimal(38,12)")


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: bounds applied, null kept null.

    ``least``/``greatest`` skip nulls, so a bare one would turn a null into
    the bound; the ``when`` guard keeps it null.
    """
    v = c(x)
    out = v
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(v.isNotNull(), out)


def season(month: str | Column) -> Column:
    m = c(month)
    return (F.when(m.isin(12, 1, 2), "Winter")
            .when(m <= 5, "Spring")
            .when(m <= 8, "Summer")
            .otherwise("Fall"))


def cyclic(x: str | Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * c(x) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def lead_time_bucket(days: str | Column) -> Column:
    d = c(days)
    out = None
    for hi, label in LEAD_BUCKETS:
        out = F.when(d <= hi, label) if out is None else out.when(d <= hi, label)
    return out.otherwise(LEAD_BUCKET_LAST)


def occ_band(x: str | Column) -> Column:
    """``pd.cut`` semantics: (lo, hi]; values at or below the first edge are null."""
    v = c(x)
    out = None
    for lo, hi, label in zip(OCC_BAND_EDGES[:-1], OCC_BAND_EDGES[1:], OCC_BAND_LABELS):
        cond = (v > lo) & (v <= hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def year_month(year: str | Column, month: str | Column) -> Column:
    return F.concat_ws("-", c(year).cast("string"), F.lpad(c(month).cast("string"), 2, "0"))


def relabel(index: str | Column, labels: Sequence[str], base: int = 0) -> Column:
    """Position lookup in a literal array (``labels[index - base]``)."""
    arr = F.array(*[F.lit(s) for s in labels])
    return F.element_at(arr, (c(index) - F.lit(base) + 1).cast("int"))


def map_lookup(x: str | Column, mapping: dict, default=None) -> Column:
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    out = m[c(x)]
    return out if default is None else F.coalesce(out, F.lit(default))


def sample_skew(x: str | Column) -> Column:
    """Bias-corrected sample skewness (pandas ``skew``) from Spark's population one."""
    n = F.count(c(x)).cast("double")
    return F.skewness(c(x)) * F.sqrt(n * (n - 1)) / (n - 2)


# --- fixed values: rational approximations of the normal quantile (algorithm AS 241) ---
# Numerator and denominator by rising power, for the middle, the near and the far tail.
PPF_MIDDLE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
               4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
              [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
               2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
PPF_NEAR = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
             1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
            [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
             1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
PPF_FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
           [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])
# ---------------------------------------------------------------------------


def _ratio(r: Column, parts: tuple[list[float], list[float]]) -> Column:
    def poly(coefs):
        out = F.lit(coefs[-1])
        for a in reversed(coefs[:-1]):
            out = out * r + a
        return out
    return poly(parts[0]) / poly(parts[1])


def normal_quantile(p: str | Column) -> Column:
    """The standard normal quantile of ``p`` in (0, 1), to about 16 digits; null outside."""
    p = c(p)
    q = p - 0.5
    tail = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    far = F.when(tail <= 5, _ratio(tail - 1.6, PPF_NEAR)).otherwise(_ratio(tail - 5, PPF_FAR))
    out = F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, PPF_MIDDLE)).otherwise(F.signum(q) * far)
    return F.when((p > 0) & (p < 1), out)
