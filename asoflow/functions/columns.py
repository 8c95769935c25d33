"""Scalar rules as column expressions."""

import math
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that a row breaks, null if none (an unknown test breaks nothing)."""
    return F.coalesce(*[F.when(test, reason) for test, reason in rules])


def all_reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The names of all rules that a row breaks, in order."""
    return F.filter(F.array(*[F.when(test, reason) for test, reason in rules]), lambda x: x.isNotNull())


def normalized_code(column: Column, upper: bool = False) -> Column:
    return F.upper(F.trim(column)) if upper else F.lower(F.trim(column))


def nfc(column: Column) -> Column:
    """Unicode NFC. Texts of ASCII are so already and skip Python."""
    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return F.when(column.rlike(r"^[\x00-\x7F]*$"), column).otherwise(compose(column))


def nfkc_casefold(column: Column) -> Column:
    """Unicode NFKC, then full case folding; null stays null."""
    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")

    return fold(column)


def minor_units(amount: Column, scale: int = 100) -> Column:
    """An exact amount in minor units; null if it isn't a whole number of them."""
    scaled = amount.cast("decimal(30,8)") * scale
    return F.when(scaled == F.floor(scaled), scaled.cast("long"))


def calendar(day: Column) -> dict[str, Column]:
    """Monday is 0."""
    return {
        "weekday": F.weekday(day).cast("long"), "iso_week": F.weekofyear(day).cast("long"), "month": F.month(day).cast("long"),
        "quarter": F.quarter(day).cast("long"), "is_weekend": F.weekday(day) >= 5,
    }


def interval_score(y: Column, low: Column, high: Column, coverage: float) -> Column:
    """Width plus what misses, weighted by 2 / (1 - coverage)."""
    miss = F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))
    return (high - low) + F.lit(2.0 / (1.0 - coverage)) * miss


def band(p: Column, q: Column) -> tuple[Column, Column]:
    """A forecast's band from a residual quantile; a null quantile gives none."""
    return F.when(q.isNotNull(), F.greatest(F.lit(0.0), p - q)), p + q


def stable_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def forest_score(depth: Column, left: Column, sample: int) -> Column:
    """Anomaly score of a mean depth whose leaf still holds `left` rows, in trees of `sample` rows: 2 ** -(depth + c(left)) / c(sample)."""
    euler = 0.5772156649015329

    def c(n: float) -> float:
        return 2 * (math.log(n - 1) + euler) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    of_left = F.when(left > 2, 2 * (F.ln(left - 1) + euler) - 2 * (left - 1) / left).when(left == 2, 1.0).otherwise(0.0)
    return F.pow(F.lit(2.0), -(depth + of_left) / c(sample))


def volume_bin(mean: Column) -> Column:
    return F.when(mean.isNull(), "unknown").when(mean == 0, "zero").when(mean < 50, "low").when(mean < 150, "medium").otherwise("high")


def reliability_bin(p: Column, bins: int = 5) -> Column:
    """Equal widths, the last one closed."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long")


def risk_band(p: Column) -> Column:
    return F.when(p.isNull(), "unknown").when(p < 0.2, "low").when(p < 0.5, "medium").when(p < 0.8, "high").otherwise("critical")


def intermittency(share_zero: Column) -> Column:
    return F.when(share_zero.isNull(), "unknown").when(share_zero < 0.25, "regular").when(share_zero < 0.75, "intermittent").otherwise("sparse")


def freshness(now: Column, built: Column, watermark: Column, observed: Column, newer: Column, max_age_days: int, max_lag_days: int) -> Column:
    """status and first reason: what makes a result stale, or why that can't be known."""
    reason = first_reason(
        [
            (newer, "newer_unpublished"), (F.datediff(now, built) > max_age_days, "too_old"), (watermark.isNull(), "watermark_missing"),
            (F.datediff(built, watermark) > max_lag_days, "watermark_lag"), (observed.isNull(), "observation_missing"), (F.datediff(built, observed) > max_lag_days, "observation_lag"),
        ]
    )
    status = F.when(reason.isNull(), "current").when(reason.endswith("missing"), "unknown").otherwise("stale")
    return F.struct(status.alias("status"), reason.alias("reason"))


def factors(**values: Column) -> Column:
    """(code, value) of the values that are there."""
    pairs = [F.struct(F.lit(k).alias("code"), v.cast("string").alias("value")) for k, v in values.items()]
    return F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The UUID of version 5 for a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def signed_round(value: Column, places: int) -> Column:
    """Rounded half away from zero as by round, but a negative number that becomes zero keeps its sign, as in SQL on binary doubles."""
    return F.signum(value) * F.round(F.abs(value), places)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def impute_encode(value: Column, fill: Column, name: str) -> dict[str, Column]:
    return {name: F.coalesce(value, fill), f"{name}__missing": value.isNull().cast("int")}


def one_hot(value: Column, vocabulary: Sequence[str], name: str) -> dict[str, Column]:
    """A column for each known value, one for null and one for values that training never saw."""
    out = {f"{name}_{v}": F.coalesce((value == v).cast("int"), F.lit(0)) for v in vocabulary}
    out[f"{name}__missing"] = value.isNull().cast("int")
    out[f"{name}__unknown"] = F.coalesce((~value.isin(*vocabulary)).cast("int"), F.lit(0))
    return out


def easter_sunday(year: Column) -> Column:
    """Date of Easter in the Gregorian calendar, by the computus, in whole numbers."""

    def div(x: Column, n: int) -> Column:
        return F.floor(x / n).cast("int")

    y = year.cast("int")
    a, b, c = y % 19, div(y, 100), y % 100
    g = div(b - div(b + 8, 25) + 1, 3)
    h = (a * 19 + b - div(b, 4) - g + 15) % 30
    w = (32 + (b % 4) * 2 + div(c, 4) * 2 - h - c % 4) % 7
    n = h + w - div(a + h * 11 + w * 22, 451) * 7 + 114
    return F.make_date(y, div(n, 31), n % 31 + 1)


def movable_days(day: Column) -> dict[str, Column]:
    """Flags of a day: Easter (Sunday and Monday), Christmas (25 and 26 December), Black Friday (the day after November's fourth Thursday) and the Monday after it, and public holidays (New Year, Easter Monday, 1 May, Christmas)."""
    easter = easter_sunday(F.year(day))
    md = F.month(day) * 100 + F.dayofmonth(day)
    black = (F.month(day) == 11) & (F.dayofweek(day) == 6) & F.dayofmonth(day).between(23, 29)
    cyber_of = F.date_sub(day, 3)
    cyber = (F.month(cyber_of) == 11) & (F.dayofweek(cyber_of) == 6) & F.dayofmonth(cyber_of).between(23, 29)
    christmas = md.isin(1225, 1226)
    return {
        "is_public_holiday": md.isin(101, 501) | christmas | (day == F.date_add(easter, 1)), "is_easter": (day == easter) | (day == F.date_add(easter, 1)),
        "is_christmas": christmas, "is_black_friday": black, "is_cyber_monday": cyber,
    }
