"""Official releases and decisions: facts from the text of pages, as column expressions. What is not found is null.

A text is cut into sentences and words; a fact is what stands at the places around a phrase: the verb after the subject, the number
after the verb, the unit and the period after the number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mixed_fraction, squeeze
from ..operators.temporal import local_instant, next_scheduled

# Words for a fall, a rise and no change in the pages' sentences, month names, and the rates' names in a decision.
FALLS = ("declined", "decreased", "fell", "down")
RISES = ("rose", "increased", "advanced", "grew", "up")
STILL = ("unchanged",)
LITTLE = ("little",)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
KEY_RATES = {"deposit": "deposit facility", "lending": "marginal lending facility", "refinancing": "main refinancing operations"}

NEW_YORK = "America/New_York"


def _even(text: Column) -> Column:
    """One kind of space and of hyphen."""
    return F.regexp_replace(F.translate(text, "‐‑‒–−", "-----"), r"[\s ]+", " ")


def _sentences(text: Column) -> Column:
    return F.split(_even(text), r"(?<=[\p{L}\p{N})%][.!?])\s(?=\p{Lu})")


def _words(text: Column) -> Column:
    """Lower-case words without the punctuation around them; signs, decimals and '%' stay."""
    bare = F.transform(F.split(F.lower(_even(text)), " "), lambda w: F.regexp_replace(w, r"^[(\[\"'“]+|[)\],;:.!?\"'”*]+$", ""))
    return F.filter(bare, lambda w: w != "")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(words: Column, test: Callable[[Column], Column], after: Column | int = 0) -> Column:
    """Place (from 1) of the first word behind ``after`` that passes; null if none does."""
    return _let(F.lit(after) if isinstance(after, int) else after, lambda a: F.get(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > a) & test(F.get(words, i - 1))), F.lit(0)))


def _behind(words: Column, phrase: str, last: bool = False) -> Column:
    """Place of the last word of the first (or last) occurrence of a phrase; null without one."""
    own = phrase.split()
    ends = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i >= len(own)) & (F.slice(words, F.greatest(i - len(own) + 1, F.lit(1)), len(own)) == F.array(*map(F.lit, own))))
    return F.get(F.reverse(ends) if last else ends, F.lit(0))


def _number(word: Column) -> Column:
    return F.regexp_replace(word, ",", "").try_cast("double")


def _found(text: Column, fact: Callable[[Column], Column]) -> Column:
    """The first sentence's fact that is there."""
    return F.get(F.filter(F.transform(F.transform(_sentences(text), _words), fact), lambda x: x.isNotNull()), F.lit(0))


def change(text: Column, subject: str, unit: str | None = None, months: int | None = None, basis: bool = False) -> Column:
    """The signed figure of '<subject> <verb> ... <number> <unit>'; 0 for no change. A number with a sign keeps its own, whatever the verb; a short one behind 'in' or a month is a date.

    With ``months`` the sentence must name that period: 'over the <months> months', or for one month 'in <month>' or 'over the month' right behind the figure, with ``basis`` also the words
    on seasonal adjustment. Other periods, as 'over the last 12 months', are no figure of a month.
    """

    def figure(words: Column, verb: Column, at: Column) -> Column:
        said, word = F.get(words, verb - 1), F.get(words, at - 1)
        still, size, signed = said.isin(*STILL), _number(word), word.rlike("^[+-]")
        tail = F.slice(words, F.when(still, verb + 1).otherwise(at + (2 if unit else 1)), F.lit(14))
        over = _behind(tail, "over the")
        period = F.when(F.get(tail, over + 1).isin("months", "month"), F.get(tail, over).try_cast("int"))
        begins = lambda phrase: F.coalesce(F.array_join(F.slice(tail, 1, len(phrase.split())), " ") == phrase, F.lit(False))
        monthly = begins("over the month") | ((F.get(tail, F.lit(0)) == "in") & F.get(tail, F.lit(1)).isin(*MONTHS))
        if basis:
            monthly = monthly | begins("on a seasonally adjusted basis")
        fits = F.get(words, at) == unit if unit else F.lit(True)
        value = F.when(signed & fits, size).when(said.isin(*FALLS) & fits, -size).when(said.isin(*RISES) & fits, size)
        value = F.when(still, F.when(signed & fits, size).otherwise(0.0)).otherwise(value)  # 'was essentially unchanged (-4,000)'
        if months is None:
            return value
        named = F.coalesce(period == months, monthly) if months == 1 else period == months
        return F.when(named, value)

    def fact(words: Column) -> Column:
        verb = _first(words, lambda w: w.isin(*FALLS, *RISES, *STILL, *LITTLE), _behind(words, subject))
        number = lambda v: F.get(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > v) & _number(F.get(words, i - 1)).isNotNull() & ~(F.get(words, i - 1).rlike(r"^\d{1,4}$") & F.get(words, F.greatest(i - 2, F.lit(0))).isin("in", *MONTHS))), F.lit(0))
        return _let(verb, lambda v: _let(number(v), lambda a: figure(words, v, a)))

    return _found(text, fact)


def consumer_prices(text: Column, months: int = 1) -> Column:
    """Percent change of all items: of the month, or of the ``months`` that a page without monthly figures names."""
    return change(text, "consumer price index for all urban consumers cpi-u", "percent", months, basis=True)


def core_prices(text: Column, months: int = 1) -> Column:
    return change(text, "index for all items less food and energy", "percent", months)


def payrolls(text: Column) -> Column:
    """Thousands of persons."""
    return change(text, "total nonfarm payroll employment") / 1000


def archive_links(html: Column, kind: str, site: str = "https://www.bls.gov") -> Column:
    """The releases that an index page links to: an array of (observation_period as yyyy-MM, url, label). Only pages of the kind's archive, no other formats; a label without month and year is left out."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))

    def link(anchor: Column) -> Column:
        path = F.regexp_extract(anchor, r"(?i)href\s*=\s*[\"']([^\"']*)", 1)
        label = squeeze(F.regexp_replace(anchor, "<[^>]*>", " "))
        month = F.try_to_timestamp(F.regexp_extract(label, r"([A-Z][a-z]+ \d{4})", 1), F.lit("MMMM yyyy"))
        wanted = path.rlike(rf"(?i)/archives/{kind}_\d{{8}}\.html?$") & month.isNotNull()
        return F.when(wanted, F.struct(F.date_format(month, "yyyy-MM").alias("observation_period"), F.when(path.startswith("/"), F.concat(F.lit(site), path)).otherwise(path).alias("url"), label.alias("label")))

    return F.filter(F.transform(anchors, link), lambda x: x.isNotNull())


def _date(words: Column, after: Column | int = 0, day_first: bool = False) -> Column:
    """The first written date behind a place: 'March 5, 2021', or '5 March 2021' with ``day_first``."""
    shift = -2 if day_first else 0
    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > (F.lit(after) if isinstance(after, int) else after)) & F.get(words, i - 1).isin(*MONTHS) & F.get(words, F.greatest(i + shift, F.lit(0))).rlike(r"^\d{1,2}$") & F.get(words, i + (0 if day_first else 1)).rlike(r"^\d{4}$"))
    at = F.get(places, F.lit(0))
    parts = [F.get(words, at + shift), F.initcap(F.get(words, at - 1)), F.get(words, at + (0 if day_first else 1))]
    return F.try_to_timestamp(F.concat_ws(" ", *parts), F.lit("d MMMM yyyy")).cast("date")


def _clock(words: Column, after: Column) -> tuple[Column, Column]:
    """Minutes since midnight of the first 'h:mm a.m.' behind a place, and the zone named next."""
    at = _first(words, lambda w: w.rlike(r"^\d{1,2}:\d\d$"), after)
    hour, minute = (F.split_part(F.get(words, at - 1), F.lit(":"), F.lit(k)).try_cast("int") for k in (1, 2))
    half = F.substring(F.get(words, at), 1, 1)
    minutes = F.when(half.isin("a", "p") & (hour <= 12) & (minute < 60), hour % 12 * 60 + minute + F.when(half == "p", 720).otherwise(0))
    return minutes, F.get(words, at + 1)


def _instant(day: Column, minutes: Column) -> Column:
    return F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0)))


def embargo(text: Column) -> Column:
    """Naive UTC instant up to which a page says that it is embargoed, on New York's clock."""

    def instant(words: Column, start: Column) -> Column:
        minutes, zone = _clock(words, start)
        return F.when(zone == "et", _instant(_date(words, start), minutes))

    return _let(_words(text), lambda words: _let(_behind(words, "embargoed until"), lambda start: instant(words, start)))


def statement_time(text: Column) -> Column:
    """Naive UTC instant of the page's 'for release at' clock on its first date; null if the zone named is not the one of that day."""
    words = _words(text)
    minutes, zone = _clock(words, _behind(words, "for release at"))
    at = _instant(_date(words), minutes)
    ahead = F.timestamp_diff("HOUR", F.convert_timezone(F.lit("UTC"), F.lit(NEW_YORK), at), at)
    return F.when(zone == F.when(ahead == 4, "edt").when(ahead == 5, "est"), at)


def target_range(text: Column) -> Column:
    """(lower, upper) of the federal funds rate, in percent; null unless 0 <= lower <= upper <= 30."""

    def fact(words: Column) -> Column:
        return _let(_behind(words, "target range for the federal funds rate"), lambda subject: behind(words, subject))

    def behind(words: Column, subject: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > subject) & (F.get(words, i) == "to") & (F.get(words, i + 2) == "percent") & mixed_fraction(F.get(words, F.greatest(i - 1, F.lit(0)))).isNotNull() & mixed_fraction(F.get(words, i + 1)).isNotNull())
        at = F.get(ends, F.lit(0))
        low, high = mixed_fraction(F.get(words, at - 1)), mixed_fraction(F.get(words, at + 1))
        return F.when((low >= 0) & (low <= high) & (high <= 30), F.struct(low.alias("lower"), high.alias("upper")))

    return _found(text, fact)


def key_rates(text: Column) -> Column:
    """Map of the three key rates: of the first sentence that names them all and gives three percentages, 'respectively', in the names' order."""

    def fact(words: Column) -> Column:
        return _let(_behind(words, "respectively"), lambda end: before(words, end))

    def before(words: Column, end: Column) -> Column:
        named = F.array(*(F.struct(_behind(F.slice(words, 1, F.coalesce(end, F.lit(0))), phrase, last=True).alias("at"), F.lit(name).alias("name")) for name, phrase in KEY_RATES.items()))
        given = F.filter(F.slice(words, F.array_min(F.transform(named, lambda x: x["at"])) + 1, F.lit(60)), lambda w: w.rlike(r"^\d+([.,]\d+)?%$"))
        values = F.transform(given, lambda w: F.translate(w, ",%", ".").cast("double"))
        return F.when(F.forall(named, lambda x: x["at"].isNotNull()) & (F.size(values) == 3), F.map_from_arrays(F.transform(F.array_sort(named), lambda x: x["name"]), values))

    return _found(F.regexp_replace(text, r"(\d)\s+%", "$1%"), fact)


def effective_date(text: Column) -> Column:
    return _let(_words(text), lambda words: _let(_behind(words, "with effect from"), lambda start: _date(words, start, day_first=True)))


def schedule_days(html: Column) -> Column:
    """Sorted release days of a yearly schedule table: each row a month's name and cells of day numbers; the year stands before the table."""
    rows = F.split(html, "(?i)<tr")
    year = F.regexp_extract(F.regexp_replace(F.get(rows, F.lit(0)), "<[^>]*>", " "), r"\b(20\d\d)\b", 1)

    def days(row: Column) -> Column:
        words = _words(F.regexp_replace(F.concat(F.lit("<tr"), row), "<[^>]*>", " "))
        given = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike(r"^\d{1,2}$"))
        dates = F.transform(given, lambda d: F.try_to_timestamp(F.concat_ws(" ", d, F.initcap(F.get(words, F.lit(0))), year), F.lit("d MMMM yyyy")).cast("date"))
        return F.when(F.get(words, F.lit(0)).isin(*MONTHS), F.filter(dates, lambda d: d.isNotNull())).otherwise(F.array().cast("array<date>"))

    return F.array_sort(F.flatten(F.transform(rows, days)))


def positions(reports: DataFrame, schedule: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Weekly positions with their net, its share of open interest and the instant from which they may be used.

    ``reports`` has ``report_date``, ``open_interest`` and, for each value of ``groups`` (name -> column prefix), ``<prefix>_long`` and
    ``<prefix>_short``; ``schedule`` has ``release``, the planned days. A report is out at 15:30 in New York on the first planned day within ten days of
    its own, and counts as available from the next local midnight; without a planned day that is unknown. Reports without positive open interest, with a
    negative or missing position, or for a day that occurs twice are marked in ``reject`` and have no figures.
    """
    sides = [f"{p}_{side}" for p in groups.values() for side in ("long", "short")]
    planned = next_scheduled(reports.select(F.col("report_date").alias("day")).where("day is not null"), schedule)
    counts = reports.groupBy("report_date").agg(F.count("*").alias("_copies"))
    rows = reports.join(counts, "report_date").join(planned.withColumnRenamed("day", "report_date"), "report_date")
    reject = F.when(F.col("_copies") > 1, "duplicate_date").when(~F.coalesce(F.col("open_interest") > 0, F.lit(False)), "open_interest").when(F.coalesce(F.least(*(F.coalesce(F.col(c), F.lit(-1)) for c in sides)) < 0, F.lit(True)), "negative_position").otherwise("")
    rows = rows.withColumn("reject", reject)
    fine = F.col("reject") == ""
    figures = []
    for name, prefix in groups.items():
        net = F.when(fine, F.col(f"{prefix}_long") - F.col(f"{prefix}_short"))
        figures += [net.alias(f"{name}_net"), (net / F.when(fine, F.col("open_interest"))).alias(f"{name}_net_share")]
    known = F.col("release").isNotNull()
    at = [local_instant(F.col("release"), "15:30", NEW_YORK).alias("scheduled_at"), local_instant(F.col("release"), "00:00", NEW_YORK, 1).alias("available_at")]
    return rows.select("report_date", "open_interest", *figures, *at, F.when(known, "inferred_conservative").otherwise("unknown").alias("time_quality"), "reject")
