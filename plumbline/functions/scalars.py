"""Column expressions: status rules, intervals, angles, seeds, time scales."""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(t: Column) -> Column:
    """A timestamp (with or without zone) as Unix seconds, with microseconds."""
    return F.unix_micros(t.cast("timestamp")) / 1e6


def wilson_lower(successes: Column, trials: Column, z: float = 1.959963984540054) -> Column:
    """The lower end of Wilson's interval; null without trials."""
    p = successes / trials
    centre = p + z * z / (2 * trials)
    spread = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    return F.when(trials > 0, F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / trials)))


def signed_square(x: Column) -> Column:
    return x * F.abs(x)


def haversine(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Separation in radians of two places in degrees."""
    a = F.pow(F.sin(F.radians(dec2 - dec1) / 2), 2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.pow(F.sin(F.radians(ra2 - ra1) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rotate_shear(e1: Column, e2: Column, ra_l: Column, dec_l: Column, ra_s: Column, dec_s: Column) -> tuple[Column, Column]:
    """Tangential and cross parts of a spin-2 ellipticity about a lens, on a flat sky; degrees, ra the short way round."""
    east = ra_s - ra_l
    east = F.when(east > 180, east - 360).when(east < -180, east + 360).otherwise(east)
    angle = F.atan2(dec_s - dec_l, east * F.cos(F.radians(dec_l)))
    c, s = F.cos(2 * angle), F.sin(2 * angle)
    return -(e1 * c + e2 * s), e1 * s - e2 * c


def unix_timestamp(s: Column) -> Column:
    """Unix seconds as a timestamp, with microseconds."""
    return F.timestamp_micros(F.round(s * 1e6).cast("long"))


def utc(text: Column) -> Column:
    """A time in a text as a timestamp: with a zone (Z, +hh:mm, -hh:mm at its end) converted, without one taken as UTC; null where
    it does not parse."""
    bare = F.trim(text)
    return F.try_to_timestamp(F.when(bare.rlike(r"(Z|[+-]\d\d:?\d\d)$"), bare).otherwise(F.concat(bare, F.lit("Z"))))


def iso(t: Column) -> Column:
    """A timestamp as ISO text in UTC, to the second, with Z. The session's zone must be UTC, as session.build sets it."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def range_total(text: Column) -> Column:
    """The number behind the last slash of a text such as a Content-Range; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"/(\d+)$", 1), F.lit("")).cast("long")


def quadrature(*sigmas: Column) -> Column:
    """The root of the sum of squares."""
    return F.sqrt(sum((s * s for s in sigmas[1:]), sigmas[0] * sigmas[0]))


def lensing_shadow(log_bar: Column, log_obs: Column, sigma: Column, z: float = 1.96, tail: float = -15.0) -> list[Column]:
    """From the logarithms of two accelerations and the error of the second: eta, their signed difference, its envelope (low, high),
    the state of its sign, and whether the first lies in the tail."""
    bar, at = F.pow(F.lit(10.0), log_bar), lambda x: F.pow(F.lit(10.0), x)
    low, high = at(log_obs - z * sigma) - bar, at(log_obs + z * sigma) - bar
    ending = "CONDITIONAL_SENSITIVITY_ENVELOPE_95"
    state = F.when(low > 0, f"POSITIVE_{ending}").when(high < 0, f"NEGATIVE_{ending}").otherwise(f"SIGN_AMBIGUOUS_{ending}")
    reach = F.when(log_bar < tail, "LOW_ACCELERATION_TAIL_SYSTEMATICS_DOMINANT").otherwise("DECLARED_PRIMARY_RANGE")
    made = {"eta": log_obs - log_bar, "difference": at(log_obs) - bar, "low": low, "high": high, "status": state, "reach": reach}
    return [c.alias(k) for k, c in made.items()]


def log10_excess_status(value: Column, sigma: Column, cut: float = 2.0) -> Column:
    """A typed state for a signed excess in units of its error."""
    return F.when(sigma.isNull() | (sigma <= 0), "NOT_ESTIMABLE").when(value / sigma >= cut, "POSITIVE_EXCESS").when(value / sigma <= -cut, "NEGATIVE_EXCESS").otherwise("CONSISTENT_WITH_ZERO")


def seed_phase(seed: str, domain: Column) -> Column:
    """A phase in [0, 1) from sha256(seed, NUL, domain): its first eight bytes, the greatest first, over 2^64."""
    digest = F.sha2(F.concat(F.lit(seed), F.lit("\x00"), domain).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / float(1 << 64)


def seed_commitment(seed: Column) -> Column:
    """sha256 of a seed given as 64 hex digits; null for any other text."""
    return F.when(seed.rlike("^[0-9a-fA-F]{64}$"), F.sha2(F.unhex(seed), 256))


#: The origin of GPS seconds past J2000 in UTC, and the UTC instants from which one more leap second counts.
GPS_ORIGIN = datetime(2000, 1, 1, 11, 59, 47, tzinfo=timezone.utc)
LEAPS = [datetime(y, m, 1, tzinfo=timezone.utc) for y, m in ((2006, 1), (2009, 1), (2012, 7), (2015, 7), (2017, 1))]


def _leaps(unix: Column) -> Column:
    return sum((F.when(unix >= at.timestamp(), 1).otherwise(0) for at in LEAPS), F.lit(0))


def gps_second(unix: Column) -> Column:
    """Continuous GPS seconds past J2000 of Unix seconds (UTC)."""
    return unix - GPS_ORIGIN.timestamp() + _leaps(unix)


def unix_second(gps: Column) -> Column:
    """Unix seconds of continuous GPS seconds, away from leap instants: leaps are counted at the last guess, three times."""
    base = gps + GPS_ORIGIN.timestamp()
    guess = base
    for _ in range(3):
        guess = base - _leaps(guess)
    return guess


def unit_interval(t: Column, low: Column, high: Column) -> Column:
    """t from -1 at low to 1 at high."""
    return 2 * (t - low) / (high - low) - 1


def turns_to_radians(turns: Column) -> Column:
    return 2 * math.pi * turns


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; null where b is not above 0."""
    return F.when(b > 0, a / b)


def fixed_acceleration_radius(mass: Column, acceleration: Column) -> Column:
    """kpc at which a mass in solar masses makes an acceleration in m/s^2; null unless both are positive. SI gravity,
    a solar mass in kg, a kpc in m."""
    return F.when((mass > 0) & (acceleration > 0), F.sqrt(6.67430e-11 * 1.98847e30 * mass / acceleration) / 3.085677581491367e19)


def sign_evidence_bits(p: Column, n: Column) -> Column:
    """Bits against a sign by chance from the share p of n draws: two-sided, no less likely than 1 / (n + 1)."""
    return -F.log2(F.greatest(2 * F.least(p, 1 - p), 1 / (n + 1)))


def bias_corrected(value: Column, k: Column) -> Column:
    return value / (1 + k)


def snap(x: Column, grid: list[float], tolerance: float) -> Column:
    """The value of a grid (a parameter) nearest to x, the smaller on a tie; null beyond the tolerance."""
    best = F.array_min(F.transform(F.array(*map(F.lit, sorted(grid))), lambda g: F.struct(F.abs(x - g).alias("d"), g.alias("g"))))
    return F.when(best["d"] <= tolerance, best["g"])


def scaled_noise(value: Column, shots: Column, base: float = 141.0) -> Column:
    """Noise of `base` shots carried to another number of shots."""
    return value / F.sqrt(shots / base)


def resolution_error(found: Column, true: Column, span: Column) -> Column:
    """A frequency's error in units of its resolution, 1 / span."""
    return F.abs(found - true) * span
