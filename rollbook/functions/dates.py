"""Dates from text, validity and notice stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.text import clean, col, once

# The year before each era's first one, by the letter that stands for it.
ERA_START = {"R": 2018, "H": 1988, "S": 1925, "T": 1911, "M": 1867}
ERA_NAMES = {"令和": "R", "平成": "H", "昭和": "S", "大正": "T", "明治": "M"}
# Years of validity, by a word in the qualification; the first that fits.
VALIDITY_YEARS = (("ﾎﾞｲﾗ", 2), ("ボイラ", 2), ("boiler", 2), ("jis", 1), ("ｊｉｓ", 1))
OTHER_VALIDITY_YEARS = 3

# Signs that stand for "until" between two days.
UNTIL = "〜~-－—–至から"

#: A day as numbers with signs between them, an era's name before the first, or eight digits. One form for all: what it found is
#: told apart by its first number.
_ERA = "[RHSTMrhstm令和平成昭大正明治]{1,2}"
SIGNED_DAY = rf"(?:{_ERA}\s*\d{{1,2}}|\d{{2,4}})\s*[-./年]\s*\d{{1,2}}\s*[-./月]\s*\d{{1,2}}日?"
ANY_DAY = rf"{SIGNED_DAY}|\d{{8}}"
FULL, OF_ERA, SHORT = 1, 2, 3
GAP = 16


@dataclass(frozen=True)
class DueConfig:
    """Days before expiry within which rows are due, whether expired rows are, and the notices' days before expiry."""

    window: int = 90
    overdue: bool = True
    first: int = 90
    second: int = 60
    final: int = 30


def made_date(year: Column, month: Column, day: Column) -> Column:
    """A date from texts, or null where there is no such day."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def general_date(c: Column | str) -> Column:
    """ISO-like texts, with slashes or dots too, and with a time of day that is dropped.

    Spark's cast reads the day once the form is known, which takes a fraction of the time of a parser by pattern.
    """
    def read(text: Column) -> Column:
        iso = text.rlike(r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[T ].*)?$")
        tight = text.rlike(r"^\d{8}$")
        whole = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
        return F.when(iso, F.translate(F.substring_index(F.substring_index(text, "T", 1), " ", 1), "/.", "--").try_cast("date")).when(tight, whole.try_cast("date"))

    return once(clean(c), read)


def signed_day(x: Column) -> Column:
    """(form, day) of what SIGNED_DAY found. A full year or two digits of one (under 70: 20xx) stand without blanks or
    hyphens, two digits with no words either; an era counts years from its first. Form is null for anything else.

    Most have a full year, which is known, and read, without taking them apart.
    """
    made = lambda form, text: F.struct(form.alias("form"), text.try_cast("date").alias("day"))

    def told(parts: Column) -> Column:
        name, numbers = parts["name"], parts["numbers"]
        starts = F.create_map(*[F.lit(v) for k, start in ERA_START.items() for v in (k, start)], *[F.lit(v) for k, letter in ERA_NAMES.items() for w in (k, k[0]) for v in (w, ERA_START[letter])])
        base = F.when(name != "", F.coalesce(F.try_element_at(starts, F.upper(F.right(F.trim(name), F.lit(1)))), F.try_element_at(starts, F.trim(name))))
        return once(base, lambda b: dated(numbers, b))

    def dated(numbers: Column, base: Column) -> Column:
        year = numbers[0]
        form = F.when((F.length(year) <= 2) & base.isNotNull() & ~x.contains("-"), OF_ERA).when(F.length(year).between(2, 3) & ~x.rlike(r"[-\s年月]"), SHORT)
        century = F.when(F.right(year, F.lit(2)).try_cast("int") < 70, "20").otherwise("19")
        whole = lambda f: F.when(f == OF_ERA, (base + year.try_cast("int")).cast("string")).otherwise(F.concat(century, F.right(year, F.lit(2))))
        return once(form, lambda f: made(f, F.concat(whole(f), F.lit("-"), numbers[1], F.lit("-"), numbers[2])))

    full = x.rlike(r"^\d{4}[./年]\d{1,2}[./月]\d{1,2}日?$")
    parts = F.struct(F.regexp_extract(x, r"^\D*", 0).alias("name"), F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)).alias("numbers"))
    return F.when(full, made(F.lit(FULL), F.translate(x, "./年月日", "----"))).otherwise(once(parts, told))


def jp_date(c: Column | str) -> Column:
    """The day a text holds: the first one with a full year, else the first of an era, else the first with a short year, else
    what its general form says. A day that no calendar has is null."""
    def read(text: Column, found: Column) -> Column:
        days = F.filter(F.transform(found, lambda x, i: once(signed_day(x), lambda d: F.struct(d["form"].alias("form"), i.alias("i"), d["day"].alias("day")))), lambda d: d["form"].isNotNull())
        return once(F.array_min(days), lambda d: F.when(d.isNotNull(), d["day"]).otherwise(general_date(text)))

    return once(col(c).cast("string"), lambda text: F.when(F.length(text) > 0, once(F.regexp_extract_all(text, F.lit(SIGNED_DAY), F.lit(0)), lambda found: read(text, found))))


_UNTIL = f"[{UNTIL.replace('-', chr(92) + '-')}]"


def holds_period(c: Column) -> Column:
    """Whether two days stand in a text with a sign for "until" near between them."""
    return c.rlike(_UNTIL) & c.rlike(rf"(?:{ANY_DAY})[^\n]{{0,{GAP}}}?{_UNTIL}[^\n]{{0,{GAP}}}?(?:{ANY_DAY})")


def period(c: Column) -> Column:
    """(start, end) of the first two days in a text with little more than a sign for "until" between them; null without."""
    def read(days: Column, gaps: Column) -> Column:
        between = lambda i: F.element_at(gaps, i + 1)
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(days) - 1, F.lit(1))), lambda i: (i < F.size(days)) & (F.length(between(i)) <= GAP) & between(i).rlike(_UNTIL) & ~between(i).contains("\n"))
        at = F.try_element_at(places, F.lit(1))
        return once(at, lambda i: F.when(i.isNotNull(), F.struct(jp_date(F.element_at(days, i)).alias("start"), jp_date(F.element_at(days, i + 1)).alias("end"))))

    # most texts hold no such sign, and are not searched for days
    return F.when(c.rlike(_UNTIL), once(F.struct(F.regexp_extract_all(c, F.lit(ANY_DAY), F.lit(0)).alias("days"), F.split(c, ANY_DAY).alias("gaps")), lambda x: read(x["days"], x["gaps"])))


def any_date(c: Column | str) -> Column:
    """General forms first, then Japanese ones before a parenthesis."""
    return F.coalesce(general_date(c), jp_date(F.substring_index(F.substring_index(clean(c), "(", 1), "（", 1)))


def paren_year(c: Column | str) -> Column:
    """The digits in parentheses as a year; one or two digits are of this century."""
    digits = F.regexp_extract(col(c).cast("string"), r"[(（]\s*(\d{1,4})\s*[)）]", 1)
    return F.when(digits == "", None).when(F.length(digits) <= 2, digits.try_cast("int") + 2000).otherwise(digits.try_cast("int"))


def window_bounds(c: Column | str) -> tuple[Column, Column]:
    """The first and the second yyyy/mm/dd of a text."""
    found = F.regexp_extract_all(col(c).cast("string"), F.lit(r"(\d{4}/\d{1,2}/\d{1,2})"), F.lit(1))
    return tuple(F.try_to_date(F.try_element_at(found, F.lit(n)), "yyyy/M/d") for n in (1, 2))


def utc_timestamp(c: Column | str) -> Column:
    """Timestamps in three usual forms, ISO, and ISO with a final Z."""
    text = F.regexp_replace(F.regexp_replace(clean(c), "Z$", ""), "T", " ")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSSSSS")), general_date(text).cast("timestamp"))


def add_years(c: Column | str, years: int | Column) -> Column:
    """The same day some years on; 29 February becomes the 28th where there is none."""
    return F.add_months(col(c), years * 12 if isinstance(years, int) else (years * 12).cast("int"))


def validity_years(qualification: Column | str) -> Column:
    text = F.lower(F.coalesce(col(qualification).cast("string"), F.lit("")))
    out = F.lit(OTHER_VALIDITY_YEARS)
    for word, years in reversed(VALIDITY_YEARS):
        out = F.when(text.contains(word), F.lit(years)).otherwise(out)
    return out


def due_columns(expiry: Column | str, as_of: Column | str, config: DueConfig = DueConfig()) -> dict[str, Column]:
    """days_to_expiry, due_within_window, notice_stage and next_notice_date of an expiry date as seen on as_of.

    The stage is the next milestone that has not passed; when all have, it is same-day. Without an expiry date nothing is
    due; expired rows are due only if the configuration wants them.
    """
    day = col(expiry).cast("date")
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("date")
    left = F.date_diff(day, now)
    stage, at = F.lit("same-day"), now
    for name, before in (("final", config.final), ("second", config.second), ("first", config.first)):
        ahead = F.date_sub(day, before) >= now
        stage, at = F.when(ahead, F.lit(name)).otherwise(stage), F.when(ahead, F.date_sub(day, before)).otherwise(at)
    outside = day.isNull() | (left > config.window)
    expired = left < 0
    return {
        "days_to_expiry": left,
        "due_within_window": F.when(outside, F.lit(False)).when(expired, F.lit(config.overdue)).otherwise(F.lit(True)),
        "notice_stage": F.when(outside, F.lit("")).when(expired, F.lit("expired" if config.overdue else "")).otherwise(stage),
        "next_notice_date": F.when(outside | expired, F.lit("")).otherwise(F.date_format(at, "yyyy-MM-dd")),
    }
