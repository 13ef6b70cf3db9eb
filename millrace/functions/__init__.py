"""Column-expression helpers with warehouse semantics (all JVM-side)."""

from millrace.functions.scalar import (  # noqa: F401
    event_time, half_up, minute_diff, null_greatest, null_least, safe_div,
    sentinel_null, three_phase_current, uid, status_colour,
    risk_band, iff, iso_timestamp, ymd, at_hour, hash_unit,
)
