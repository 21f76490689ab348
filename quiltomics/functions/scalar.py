"""Column functions of the catalogue, the events and the predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_list(values: Column) -> Column:
    """Trimmed list, or null if it is empty, holds blanks or repeats itself."""
    trimmed = F.transform(values, lambda v: F.trim(v))
    good = (
        (F.size(trimmed) > 0)
        & ~F.exists(trimmed, lambda v: v == "")
        & (F.size(F.array_distinct(trimmed)) == F.size(trimmed))
    )
    return F.when(good, trimmed)


def clean_text(value: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(value), F.lit(""))


def prefixed(source: Column, value: Column) -> Column:
    """``source::value``."""
    return F.concat(source, F.lit("::"), value)


def without_prefix(source: Column, value: Column) -> Column:
    """Value without its leading ``source::``; unchanged if it has none."""
    prefix = F.concat(source, F.lit("::"))
    return F.when(F.startswith(value, prefix), F.substr(value, F.length(prefix) + 1)).otherwise(value)


def like_literal(value: Column) -> Column:
    """Text with LIKE wildcards escaped."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit("%"), F.lit("\\%"))
    return F.replace(escaped, F.lit("_"), F.lit("\\_"))


def same_folded(left: Column, right: Column) -> Column:
    """Equality that ignores case."""
    return F.lower(left) == F.lower(right)


def iso_day(value: Column) -> Column:
    """``YYYY-MM-DD`` as a date, null if it is none."""
    return F.when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), value.try_cast("date"))


def default_range_start(end: Column) -> Column:
    """First day of the thirty days that end on ``end``."""
    return F.date_sub(end, 29)


def zoned_instant(value: Column) -> Column:
    """ISO timestamp that must name its zone; null otherwise."""
    return F.when(F.rlike(value, F.lit(r"(Z|[+-]\d{2}:\d{2})$")), value.try_cast("timestamp"))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First instant of a day and of the next one."""
    return day.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz")


def retention_cutoff(now: Column, days: int) -> Column:
    """Instant before which events are purged."""
    return now - F.make_dt_interval(F.lit(days))


def clip(value: Column, low: float, high: float) -> Column:
    """Value limited to a range."""
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def sigmoid(value: Column) -> Column:
    """Logistic function."""
    return 1 / (1 + F.exp(-value))


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even one."""
    return F.rint(value).cast("long")


def normalised_entropy(weights: Column) -> Column:
    """Entropy of weights over ``ln(K)``; K = 1 divides by one."""
    h = F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(0.0))
    return h / F.when(F.size(weights) > 1, F.ln(F.size(weights))).otherwise(1.0)


def effective_types(weights: Column) -> Column:
    """Exponential of the entropy."""
    return F.exp(F.aggregate(weights, F.lit(0.0), lambda a, w: a - F.when(w > 0, w * F.ln(w)).otherwise(0.0)))


def json_string_list(value: Column) -> Column:
    """JSON list of unique non-empty strings, null if it is none."""
    parsed = F.from_json(value, "array<string>")
    good = (
        (F.size(parsed) > 0)
        & ~F.exists(parsed, lambda v: v.isNull() | (v == ""))
        & (F.size(F.array_distinct(parsed)) == F.size(parsed))
    )
    return F.when(good, parsed)


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """JSON object with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def lookup(mapping: Column, key: Column, default: Column) -> Column:
    """Map value, or the default."""
    return F.coalesce(F.try_element_at(mapping, key), default)


def session_uuid(value: Column) -> Column:
    """Canonical lower-case UUID, null if it is none; longer input than 36 characters is none."""
    bare = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    parts = [F.substring(bare, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when((F.length(value) <= 36) & F.rlike(bare, F.lit("^[0-9a-f]{32}$")), F.concat_ws("-", *parts))


def in_range(value: Column, low: float, high: float) -> Column:
    """Finite and between the bounds."""
    number = value.try_cast("double")
    return F.coalesce(number.between(low, high) & ~F.isnan(number), F.lit(False))


def warning_list(flags: Mapping[str, Column]) -> Column:
    """Codes of the flags that are set."""
    return F.array_compact(F.array(*[F.when(f, F.lit(c)) for c, f in flags.items()]))


def status_of(uncertain: Column, mixed: Column) -> Column:
    """Uncertain outranks Mixed, Mixed outranks Predicted."""
    return F.when(uncertain, "Uncertain").when(mixed, "Mixed").otherwise("Predicted")


def any_uncertain(missing: Column, delta_below: Column, score_below: Column) -> Column:
    """Three-valued OR: an unknown test stays unknown unless another is true."""
    return missing | delta_below | score_below


def web_address(value: Column) -> Column:
    """Absolute HTTP or HTTPS address."""
    trimmed = F.trim(value)
    scheme = F.lower(F.try_parse_url(trimmed, F.lit("PROTOCOL")))
    host = F.try_parse_url(trimmed, F.lit("HOST"))
    return F.coalesce(scheme.isin("http", "https") & (F.length(host) > 0), F.lit(False))
