"""Scalar column functions.

Each helper returns a plain ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen. The helpers pin down the semantics that
differ between engines (NULL handling of GREATEST/LEAST, minute-boundary
differences, half-up rounding of doubles, division by zero).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Three-phase current factor (sqrt 3 as used), and the failure-risk
# band limits in percent (green below 30, amber below 75, red otherwise).
SQRT3 = 1.732
RISK_GREEN_BELOW, RISK_AMBER_BELOW = 30, 75


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def event_time(c, dtype: T.DataType | None = None) -> Column:
    """Parse an event time that may arrive as text or as a timestamp.

    Text that is not a timestamp becomes NULL (try-cast), timestamps pass
    through unchanged.
    """
    c = _c(c)
    if isinstance(dtype, (T.TimestampNTZType,)):
        return c
    if isinstance(dtype, T.TimestampType):
        return c.cast("timestamp_ntz")
    return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")


def half_up(x, n: int = 0) -> Column:
    """Round a non-negative DOUBLE half-up to ``n`` places, as a DOUBLE.

    ``floor(x * 10^n + 0.5) / 10^n`` -- the same operation order is used in the
    SQL oracle, so results are bit-identical; ``round()`` on doubles is not
    (engines disagree on values such as 1.005).
    """
    scale = float(10 ** n)
    return (F.floor(_c(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale))


def null_least(*cols) -> Column:
    """LEAST that returns NULL when any argument is NULL (warehouse rule)."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.least(*cs))


def null_greatest(*cols) -> Column:
    """GREATEST that returns NULL when any argument is NULL (warehouse rule)."""
    cs = [_c(c) for c in cols]
    any_null = cs[0].isNull()
    for c in cs[1:]:
        any_null = any_null | c.isNull()
    return F.when(any_null, F.lit(None)).otherwise(F.greatest(*cs))


def safe_div(a, b) -> Column:
    """a / b as DOUBLE, NULL when b is 0 (never raises under ANSI mode)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def iff(cond: Column, a, b) -> Column:
    """IFF(cond, a, b): a NULL condition takes the else branch."""
    return F.when(cond, a).otherwise(b)


def minute_diff(start, end) -> Column:
    """Minutes between two timestamps counted as minute boundaries crossed.

    10:00:59 -> 10:01:00 is 1 (warehouse TIMESTAMPDIFF semantics), so both
    sides are truncated to the minute before the difference is taken.
    """
    return F.timestamp_diff(
        "MINUTE", F.date_trunc("minute", _c(start)), F.date_trunc("minute", _c(end)))


def sentinel_null(c, sentinel: str = "None") -> Column:
    """Map the text sentinel for 'missing' to NULL."""
    return F.nullif(_c(c), F.lit(sentinel))


def three_phase_current(power_kw, voltage) -> Column:
    """kW * 1000 / (V * 1.732); 0 when the voltage is not positive."""
    v = _c(voltage)
    return F.when(v > 0, _c(power_kw) * 1000.0 / (v * SQRT3)).otherwise(F.lit(0.0))


def hash_unit(*cols) -> Column:
    """Deterministic uniform in [0, 1) from any key columns.

    The first 32 bits of SHA-256 over the '|'-joined key text; replaces random
    draws (choice, uniform) so results are repeatable, replay-safe and can be
    recomputed by other engines.
    """
    key = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") / 4294967296.0


def uid(prefix: str, *cols) -> Column:
    """``PREFIX-`` + 8 upper-case hex chars derived from the key columns."""
    key = F.concat_ws("|", *[_c(c).cast("string") for c in cols])
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(key, 256), 1, 8)))


def status_colour(status) -> Column:
    """Running/Ideal (missing counts as Ideal) -> green, anything else -> red."""
    s = F.coalesce(_c(status), F.lit("Ideal"))
    return F.when(s.isin("Running", "Ideal"), F.lit("green")).otherwise(F.lit("red"))


def risk_band(risk_pct) -> Column:
    """Failure-risk percentage -> traffic-light band (<30, <75, else)."""
    r = _c(risk_pct)
    return (F.when(r < RISK_GREEN_BELOW, F.lit("green"))
            .when(r < RISK_AMBER_BELOW, F.lit("amber"))
            .when(r.isNotNull(), F.lit("red")))


def iso_timestamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def ymd(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def at_hour(ts, hour) -> Column:
    """The timestamp's calendar day at ``hour``:00 (timestamp_ntz)."""
    h = hour if isinstance(hour, Column) else F.lit(hour)
    return F.timestamp_add("HOUR", h, F.to_date(_c(ts)).cast("timestamp_ntz"))
