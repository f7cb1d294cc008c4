"""Row-level expressions, all built from JVM-side functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from flowspark.config import ALERT_NAMES, BENIGN, AlertConfig, TraceConfig

# Cells read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
# Timestamp layouts tried in order.
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd",
    "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm",
)


def as_column(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def quoted(name: str) -> str:
    """Back-quote a column name so that dots and blanks stay part of it."""
    return "`" + name.replace("`", "``") + "`"


def blank_to_null(c) -> Column:
    c = as_column(c)
    return F.when(~F.trim(c).isin(*NA_TOKENS), c)


def binary_label(label) -> Column:
    """0 for the benign class (exact, case-sensitive after trimming), else 1."""
    return F.when(F.trim(as_column(label)) == BENIGN, 0).otherwise(1)


def has_label(label) -> Column:
    return F.coalesce(F.trim(as_column(label)) != "", F.lit(False))


def finite(c) -> Column:
    """NaN and both infinities become NULL."""
    c = as_column(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c) -> Column:
    """Text to double; what is no number is NULL, Java suffixes are no numbers."""
    c = as_column(c)
    suffixed = F.lower(F.trim(c)).rlike("[fd]$") & ~F.lower(F.trim(c)).rlike("inf$")
    return F.when(~F.coalesce(suffixed, F.lit(False)), c.try_cast("double"))


def to_timestamp(c) -> Column:
    """First layout that fits, as a timestamp without zone; else NULL."""
    c = as_column(c)
    tries = [F.try_to_timestamp(F.trim(c), F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*tries).cast("timestamp_ntz")


def at_least(score, threshold) -> Column:
    """1 where the score reaches the threshold; NULL scores never do."""
    return F.coalesce((as_column(score) >= F.lit(threshold)), F.lit(False)).cast("int")


def round_even(c, digits: int) -> Column:
    return F.bround(as_column(c), digits)


def alert_code(rf_prob, unsup_score, cfg: AlertConfig = AlertConfig()) -> Column:
    """Four-level alert as 0..3; missing scores count as below every cut."""
    rf, unsup = as_column(rf_prob), as_column(unsup_score)
    no = F.lit(False)
    rf_hit = F.coalesce(rf >= F.lit(cfg.theta_rf), no)
    unsup_hit = F.coalesce(unsup >= F.lit(cfg.theta_unsup_high), no)
    gray = F.coalesce(rf >= F.lit(cfg.theta_gray), no)
    extreme = F.coalesce(unsup >= F.lit(cfg.theta_unsup_extreme), no)
    return (
        F.when(rf_hit & unsup_hit, 3).when(rf_hit, 2).when(gray | extreme, 1).otherwise(0)
    )


def alert_name(code) -> Column:
    code = as_column(code)
    out = None
    for value, name in ALERT_NAMES.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return out


def detection_source(code) -> Column:
    """Which detector raised the alert."""
    code = as_column(code)
    return (
        F.when(code == 3, "rf+unsup").when(code == 2, "rf").when(code == 1, "suspect")
        .otherwise("benign")
    )


def is_attack(code) -> Column:
    return (as_column(code) >= 2).cast("int")


def risk_score(rf_prob, unsup_score, cfg: AlertConfig = AlertConfig()) -> Column:
    return F.lit(cfg.risk_rf) * as_column(rf_prob) + F.lit(cfg.risk_unsup) * as_column(unsup_score)


def source_role(attack_ratio, cfg: TraceConfig = TraceConfig()) -> Column:
    ratio = as_column(attack_ratio)
    return (
        F.when(ratio >= F.lit(cfg.attacker_ratio), "attacker")
        .when(ratio >= F.lit(cfg.suspect_ratio), "suspect").otherwise("normal")
    )


def hour_bin(ts) -> Column:
    return F.date_trunc("hour", as_column(ts))


def ascii_only(c) -> Column:
    return F.regexp_replace(as_column(c), "[^\\x00-\\x7F]", "?")


def min_max(score, low: float, high: float, clip: bool = False, flat: float = 0.0) -> Column:
    """Scale by a reference range; a range below ``flat`` or empty gives 0."""
    score = as_column(score)
    if low is None or high is None or high == low or high - low < flat:
        return F.when(score.isNotNull(), F.lit(0.0))
    scaled = (score - F.lit(low)) / F.lit(high - low)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) if clip else scaled


def weighted_sum(terms: Sequence[Column], weights: Sequence[float]) -> Column:
    out = None
    for term, weight in zip(terms, weights):
        part = F.lit(float(weight)) * term
        out = part if out is None else out + part
    return out


def hash_order(sample_id, seed: int, salt: str = "") -> Column:
    """Reproducible pseudo-random order key in [0, 2**60)."""
    text = F.concat(as_column(sample_id).cast("string"), F.lit(f"-{seed}{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def share(part, whole, digits: int | None = None) -> Column:
    """part / whole, 0 when the whole is empty."""
    ratio = F.coalesce(F.try_divide(as_column(part), as_column(whole)), F.lit(0.0))
    return F.bround(ratio, digits) if digits is not None else ratio
