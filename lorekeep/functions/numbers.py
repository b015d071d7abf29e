"""Column functions over numbers and vectors: clamps, ages, priors, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.functions.text import col

HALF_LIFE_DAYS, AGE_FLOOR, RESOLVED_FACTOR = 365.0, 0.5, 0.6


def coerce_confidence(raw: Column | str) -> Column:
    """A number clamped to [0, 1]; anything else, NaN and infinities are null."""
    x = F.expr(f"try_cast({raw} AS DOUBLE)") if isinstance(raw, str) else raw.try_cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull() | odd, None).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def coerce_recurrence(raw: Column) -> Column:
    """A whole number of one or more, half to even; junk is 1."""
    x = raw.try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e9)
    return F.when(ok, F.greatest(F.bround(x).cast("int"), F.lit(1))).otherwise(1)


def coerce_salience(raw: Column) -> Column:
    x = raw.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def age_days(date: Column | str, as_of: str) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), col(date)))


def age_marker(recurrence: Column | str, days: Column) -> Column:
    """How often and how old: "×3 · ~4mo"; nothing for a fresh one-off."""
    often = F.when(col(recurrence) >= 2, F.concat(F.lit("×"), col(recurrence).cast("string")))
    months = F.floor(days / 30)
    old = F.when(days >= 90, F.when(months < 12, F.concat(F.lit("~"), months.cast("string"), F.lit("mo"))).otherwise(F.concat(F.lit("~"), F.bround(days / 365.0).cast("int").cast("string"), F.lit("y"))))
    return F.concat_ws(" · ", often, old)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 when one is null, empty, zero or not finite, or sizes differ."""
    a, b = col(a), col(b)
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & value.isNotNull() & ~F.isnan(value), value).otherwise(0.0)


def salience_multiplier(days: Column, recurrence: Column | str, resolved: Column | str, confidence: Column | str, salience: Column | None = None) -> Column:
    """Age decay that recurrence slows, times discounts for resolved and unsure notes, times centrality."""
    decay = F.greatest(F.lit(AGE_FLOOR), F.pow(F.lit(0.5), days / (1 + F.log(col(recurrence).cast("double"))) / HALF_LIFE_DAYS))
    sure = F.when(col(confidence).isNull(), 1.0).otherwise(0.6 + 0.4 * col(confidence))
    out = decay * F.when(col(resolved), RESOLVED_FACTOR).otherwise(1.0) * sure
    return out if salience is None else out * (1 + 0.1 * salience)


def sign_words(vec: Column | str, dim: int) -> Column:
    """Sign bits (1 when not negative) of a vector of `dim` numbers as 64-bit words."""
    words = []
    for begin in range(0, dim, 64):
        bits = F.transform(F.slice(col(vec), begin + 1, min(64, dim - begin)), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")))
        words.append(F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b)))
    return F.array(*words)


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
