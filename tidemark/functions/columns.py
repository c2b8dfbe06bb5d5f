"""Column functions: guarded statistics, probabilities, time zones, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A variance up to this counts as zero.
FLAT = 1e-18
#: Trials up to which a sign test adds up the binomial tail term by term.
MOST_TRIALS = 20_000


def guarded_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson correlation over complete pairs; null with fewer than ``least`` pairs or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    usable = (F.count(a) >= least) & (F.var_pop(a) > FLAT) & (F.var_pop(b) > FLAT)
    return F.when(usable, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, relative error below 1.2e-7 (a rational Chebyshev fit)."""
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the fit, lowest power first.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    inner = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        inner = F.lit(c) + t * inner
    return t * F.exp(-x * x + inner)


def sign_test(k: Column, n: Column) -> Column:
    """Two-sided sign test: twice the lower binomial tail at 1/2, at most 1; no trials give 1. Exact up to ``MOST_TRIALS``; beyond, the normal tail with its correction for continuity."""
    low = F.when(n <= MOST_TRIALS, F.least(k, n - k)).otherwise(F.lit(0))
    # log C(n, i) is a sum of logs; the tail is summed from it
    tail = F.aggregate(
        F.sequence(F.lit(0), low.cast("int")), F.struct(F.lit(0.0).alias("log_c"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct(
            F.when(i == 0, F.lit(0.0)).otherwise(acc["log_c"] + F.log(((n - i + 1) / F.greatest(i, F.lit(1))).cast("double"))).alias("log_c"),
            (acc["total"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(acc["log_c"] + F.log(((n - i + 1) / F.greatest(i, F.lit(1))).cast("double"))) - n * F.log(F.lit(2.0)))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    wide = erfc(F.greatest(F.abs(n - 2 * k) - 1, F.lit(0)) / F.sqrt(2.0 * n))
    return F.when(n == 0, F.lit(1.0)).when(n > MOST_TRIALS, wide).otherwise(F.least(F.lit(1.0), 2 * tail))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Softmax of an array of doubles, shifted by its maximum."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp((s - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def tercile(value: Column, lower: Column, upper: Column) -> Column:
    """'down' below the lower bound, 'up' above the upper, else 'flat'."""
    return F.when(value < lower, "down").when(value > upper, "up").otherwise("flat")


def age_decay(age: Column, half_life: float) -> Column:
    """2 ** (-age / half_life); null for a negative age."""
    return F.when(age >= 0, F.pow(F.lit(2.0), -age / F.lit(float(half_life))))


def to_zone(ts: Column, zone: str) -> Column:
    """Wall clock in ``zone`` of a naive UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def from_zone(ts: Column, zone: str) -> Column:
    """Naive UTC time of a wall clock in ``zone``."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts)


def session_date(ts: Column) -> Column:
    """Trading day that closes at 17:00 in New York: from 17:00 on it is the next day."""
    return (to_zone(ts, "America/New_York") + F.expr("INTERVAL 7 HOURS")).cast("date")


def next_weekday(day: Column, name: str) -> Column:
    """The next such weekday strictly after the day."""
    return F.next_day(day, name)


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def strip_tags(html: Column) -> Column:
    """Visible text of simple HTML: scripts, styles and tags out, common entities decoded."""
    text = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def mixed_fraction(text: Column) -> Column:
    """'5-1/4', '1/4' or '5.25' as a number; null otherwise."""
    whole, over, under = (F.regexp_extract(text, r"^(?:(\d+)-)?(\d+)/(\d+)$", i) for i in (1, 2, 3))
    split = F.when(over != "", F.coalesce(whole.try_cast("double"), F.lit(0.0)) + over.try_cast("double") / F.nullif(under.try_cast("double"), F.lit(0.0)))
    return F.coalesce(split, text.try_cast("double"))


def compact(text: Column, most: int, marker: str = "\n[...]\n") -> Column:
    """A text longer than ``most`` keeps its head (three quarters of what the marker leaves) and its tail."""
    room = most - len(marker)
    head = room * 3 // 4
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.right(text, F.lit(room - head))))
