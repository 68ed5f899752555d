"""Licence numbers, names and dates from the text of certificates: a table (source, page, text)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.dates import holds_period, jp_date, period
from rollbook.functions.schema import worked_out
from rollbook.functions.text import among, clean, nfkc, once, redact
from rollbook.operators.identity import least_row

# Words that label a licence number, longer ones before those that they begin with; and words about dates.
LABELS = ("証明書番号", "証書番号", "登録番号", "認定番号", "資格番号", "免許番号", "免許証番号", "許可番号", "登録No", "登録№", "証番号", "登録第", "証第", "番号", "No.", "No")
DATE_WORDS = ("有効期限", "有効期間", "発行", "交付", "更新", "年月日", "年", "月", "日")
# Labels of a number in running text, and on certificates; what stands around a number, and signs before one.
NUMBER_LABELS = ("証明書番号", "証書番号", "登録番号", "認定番号", "資格番号", "番号", "No.", "No", "NO.", "NO")
CERTIFICATE_LABELS = ("登録番号", "免許番号", "資格番号", "登録No.", "登録No", "登録№", "No.", "No", "許可番号", "証番号")
BEFORE_NUMBER, AFTER_NUMBER = ("証第", "登録第"), ("号", "號")
NUMBER_SIGNS = ("No.", "No", "NO.", "NO", "記号")
# Labels of the qualification, of dates, and of periods.
KIND_LABELS = ("資格種別", "資格名称", "資格", "免許の種類")
ISSUE_LABELS = ("交付日", "発行日", "交付年月日", "発行年月日", "試験日", "受験日", "実施日", "発給日", "発効日")
EXPIRY_LABELS = ("有効期限", "有効期限日", "有効期間満了日", "満了日", "満了予定日", "有効期間")
PERIOD_LABELS = ("有効期間", "有効")
FIRST_ISSUE, ISSUE, EXPIRY = ("登録年月日",), ("継続年月日", "交付年月日", "交付日"), ("有効年月日", "有効期限")
NAME_LABELS = ("氏名",)
# The qualification of a list of names under this word.
LISTED_KIND = {"JIS": "JIS 溶接士"}
# The forms of licence numbers, of a hyphen, of a person's name, and of days in running text.
LETTERS_DIGITS, MANY_DIGITS = r"[A-Za-z]{1,4}-?\d{3,}", r"\d{6,}"
HYPHEN = "[‐‑‒–—−ー－]"
PERSON, LISTED_PERSON = "[一-鿿\u3040-ヿ]{2,8}", "[一-鿿㐀-䶿\u3040-ヿ]{2,8}"
NUMERIC_DAY, ERA_DAY = r"\d{1,4}[-./]\d{1,2}[-./]\d{1,2}", r"[RrHhSsTtMm令平昭大明][和成治正]?\s*\d{1,2}[./年]\s*\d{1,2}[./月]\s*\d{1,2}日?"

#: No letter or digit stands on this side.
OPEN, CLOSED = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Private characters that stand before a label and before its value while a text is cut into sections.
BEGIN, THEN = "\ue000", "\ue001"
#: A day counts for a label in so many characters behind it; a period in so many of its line.
NEAR, LINE = 21, 80


def one_of(words: Sequence[str]) -> str:
    """An expression for any of these words, the longest that fits."""
    return "(?:" + "|".join(w.replace(".", "\\.") for w in sorted(words, key=len, reverse=True)) + ")"


def plain(c: Column | str, normal: bool) -> Column:
    """The text in NFKC; normal: it is known to need none."""
    return (F.col(c) if isinstance(c, str) else c) if normal else nfkc(c)


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds, null without one."""
    return once(F.regexp_extract(c, pattern, group), lambda v: F.when(v != "", v))


def tidy(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, HYPHEN, "-"))


def sections(c: Column, labels: Sequence[str]) -> Column:
    """The text cut at every label: an array of (label, value), where a value goes on to the next label or the end."""
    marked = F.regexp_replace(F.translate(c, BEGIN + THEN, ""), one_of(labels), f"{BEGIN}$0{THEN}")
    parts = F.filter(F.split(marked, BEGIN), lambda p: p.contains(THEN))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, THEN, 1).alias("label"), F.substring_index(p, THEN, -1).alias("value")))


def read(parts: Column, **fields: Callable[[Column, Column], Column]) -> Column:
    """For each section its label and what fields hold, of its label and its value; each is written once, whoever reads it."""
    one = lambda s: once(F.ltrim(s["value"], F.lit(" \t：:")), lambda v: F.struct(s["label"].alias("label"), *(f(s["label"], v).alias(c) for c, f in fields.items())))
    return F.transform(parts, one)


def first_of(found: Column | str, labels: Sequence[str], field: str) -> Column:
    """The field of the first section under one of the labels that has it."""
    return F.try_element_at(F.filter(F.transform(F.filter(found, lambda s: among(s["label"], labels)), lambda s: s[field]), lambda v: v.isNotNull()), F.lit(1))


def line_of(value: Column, length: int) -> Column:
    return F.substring(F.substring_index(F.ltrim(value, F.lit(" \t\n\r：:")), "\n", 1), 1, length)


def number_after(c: Column, labels: Sequence[str], between: str, value: str) -> Column:
    """The first value right behind a label."""
    return found(c, f"{one_of(labels)}{between}({value})")


def license_number(c: Column) -> Column:
    """The number after a label, unless it is a date; else letters with digits; else six or more digits that are no date."""
    after = once(tidy(number_after(c, NUMBER_LABELS, r"[：:\-\s]*", f"[A-Za-z0-9](?:[-A-Za-z0-9]|{HYPHEN}){{2,}}")), lambda x: F.when(~is_iso(x), x))
    pattern = F.upper(found(c, rf"\b({LETTERS_DIGITS})\b"))
    digits = F.try_element_at(F.filter(F.regexp_extract_all(c, F.lit(rf"\b({MANY_DIGITS})\b"), F.lit(1)), lambda x: ~x.rlike(r"^\d{8}")), F.lit(1))
    return F.coalesce(after, pattern, digits)


def is_iso(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")


def looks_like_date(c: Column) -> Column:
    """Whether numbers stand as in a day, or a day can be read."""
    return c.rlike(rf"{OPEN}(?:\d{{4}}|\d{{2}})[-./]\d{{1,2}}[-./]\d{{1,2}}{CLOSED}") | F.coalesce(jp_date(c).isNotNull(), F.lit(False))


def license_candidates(pages: DataFrame, window: int = 1, rejected: bool = False, normal: bool = False) -> DataFrame:
    """(source, page, line_no, candidate, accepted, confidence, reason, line) for what may be a licence number in a line.

    Labels count on the line and within `window` lines of it. A text's lines stay an array, in which neighbours are found by
    their place, so nothing is shuffled; only lines with a candidate become rows, and only these are searched for dates.
    """
    labelled, generic = f"{one_of(LABELS)}[：:\\-\\s]*((?:[-A-Za-z0-9]|{HYPHEN}){{3,}})", rf"\b({LETTERS_DIGITS}|{MANY_DIGITS})\b"
    split = F.split(F.regexp_replace(plain("text", normal), "\r\n?", "\n"), "\n")
    lines = pages.select("source", "page", split.alias("lines"))
    near = lambda i: F.slice("lines", F.greatest(i + 1 - window, F.lit(1)), F.least(i, F.lit(window)) + window + 1)
    placed = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("n"), x.alias("line"))), lambda p: p["line"].rlike(f"{labelled}|{generic}"))
    some = F.transform(placed, lambda p: F.struct(p["n"].alias("n"), p["line"].alias("line"), near(p["n"]).alias("near")))
    # arrays are made before they are exploded: Spark would make them again for filters of its own
    each = worked_out(lines.select("source", "page", some.alias("p"))).select("source", "page", F.explode("p").alias("p")).select("source", "page", "p.*")
    all_found = F.filter(F.concat(F.array(found(F.col("line"), labelled)), F.regexp_extract_all("line", F.lit(generic), F.lit(1))), lambda x: x.isNotNull())
    each = worked_out(each.withColumn("has_label", F.col("line").rlike(one_of(LABELS))).withColumn("label_near", F.exists("near", lambda x: x.rlike(one_of(LABELS)))))

    def judged(c: Column) -> Column:
        reason = (
            F.when(looks_like_date(c), "reject:date_like").when(F.col("has_label"), "accept:labeled")
            .when(F.col("label_near"), "accept:adjacent_label").when(c.rlike(r"^[A-Z]{1,4}-?\d{3,}$"), "accept:pattern")
            .when(c.rlike(f"^{MANY_DIGITS}$"), "accept:numeric_long").otherwise("reject:weak_pattern"))
        return F.struct(c.alias("candidate"), reason.alias("reason"))

    candidates = F.transform(F.array_distinct(F.transform(all_found, tidy)), lambda c: once(F.coalesce(license_number(c), c), judged))
    candidates = candidates if rejected else F.filter(candidates, lambda x: x["reason"].startswith("accept"))
    each = worked_out(each.select("source", "page", "n", "line", "near", candidates.alias("c"))).withColumn("c", F.explode("c")).select("source", "page", "n", "line", "near", "c.*")
    date_near = F.exists("near", lambda x: looks_like_date(x) | x.rlike(one_of(DATE_WORDS)))
    sure = (F.when(F.col("reason") == "accept:labeled", "high").when(F.col("reason").isin("accept:adjacent_label", "accept:pattern"), "medium")
            .when(F.col("reason") == "accept:numeric_long", F.when(date_near, "low").otherwise("medium")).otherwise("low"))
    return each.select("source", "page", (F.col("n") + 1).alias("line_no"), "candidate", F.col("reason").startswith("accept").alias("accepted"), sure.alias("confidence"), "reason", F.trim("line").alias("line"))


def date_tokens(c: Column) -> Column:
    """Date-like parts of a text, each once: numbers of four or two digits first, then with any year before a note in
    parentheses, then of an era."""
    numeric = F.regexp_extract_all(c, F.lit(rf"{OPEN}{NUMERIC_DAY}{CLOSED}(?:\s*\(\d{{1,2}}\))?"), F.lit(0))
    bare = F.filter(F.transform(numeric, lambda x: F.trim(F.substring_index(x, "(", 1))), lambda x: x.rlike(r"^(?:\d{4}|\d{2})\D"))
    noted = F.filter(numeric, lambda x: x.rlike(r"^\d{1,2}[./]\d+[./].*\("))
    return F.array_distinct(F.transform(F.concat(bare, noted, F.regexp_extract_all(c, F.lit(ERA_DAY), F.lit(0))), lambda x: F.trim(x)))


def token_date(c: Column) -> Column:
    """The day that a token names; what follows in parentheses does not count."""
    return jp_date(F.substring_index(F.substring_index(c, "(", 1), "（", 1))


def date_candidates(pages: DataFrame, normal: bool = False) -> DataFrame:
    """(source, token, iso): date-like parts of each source's text and the days they name, blank where there is none."""
    each = worked_out(pages.select("source", date_tokens(plain("text", normal)).alias("tokens"))).select("source", F.explode("tokens").alias("token")).distinct()
    return each.withColumn("iso", F.coalesce(F.date_format(token_date(F.col("token")), "yyyy-MM-dd"), F.lit("")))


def names_in(c: Column) -> Column:
    """Names after '#12' and after the word for a name, each once."""
    numbered, after_word = rf"#\s*\d+\s*({LISTED_PERSON})", rf"{one_of(NAME_LABELS)}[：:]?\s*({PERSON})"
    return F.array_distinct(F.concat(*(F.regexp_extract_all(c, F.lit(way), F.lit(1)) for way in (numbered, after_word))))


def names(pages: DataFrame, normal: bool = False) -> DataFrame:
    """(source, page, name): the names in each page's text."""
    return pages.select("source", "page", F.explode(names_in(plain("text", normal))).alias("name"))


def first_day(c: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(date_tokens(c), token_date), lambda d: d.isNotNull()), F.lit(1))


def labelled_dates(pages: DataFrame, normal: bool = False) -> DataFrame:
    """(source, page, first_issue_date, issue_date, expiry_date) of pages on which a label has a date, or a period has.

    A day under a label comes before a period's; a period's start is the issue only where its end is the expiry.
    """
    parts = sections(plain("text", normal), (*FIRST_ISSUE, *ISSUE, *EXPIRY, *PERIOD_LABELS[:1]))
    found = read(parts, day=lambda label, v: first_day(line_of(v, NEAR)), period=lambda label, v: F.when(label == PERIOD_LABELS[0], period(line_of(v, LINE))))
    out = worked_out(pages.select("source", "page", found.alias("_found")))
    day = lambda labels: F.coalesce(*(first_of("_found", (label,), "day") for label in labels))
    out = worked_out(out.select("source", "page", day(FIRST_ISSUE).alias("first_issue_date"), day(ISSUE).alias("_issue"), day(EXPIRY).alias("_expiry"), first_of("_found", PERIOD_LABELS[:1], "period").alias("_period")))
    out = out.withColumn("expiry_date", F.coalesce("_expiry", "_period.end")).withColumn("issue_date", F.coalesce("_issue", F.when(F.col("_expiry").isNull() & F.col("_period.end").isNotNull(), F.col("_period.start"))))
    return out.where(F.coalesce("first_issue_date", "issue_date", "expiry_date").isNotNull()).select("source", "page", "first_issue_date", "issue_date", "expiry_date")


def certificate_number(c: Column) -> Column:
    """The number after a label, between the words that enclose one, or after a sign; else as in running text; else two or
    three letters or digits with four digits or more."""
    enclosed = found(c, rf"{one_of(BEFORE_NUMBER)}\s*([A-Za-z0-9\-]+)\s*{one_of(AFTER_NUMBER)}")
    return F.coalesce(number_after(c, CERTIFICATE_LABELS, r"[：:]?\s*", r"[A-Za-z0-9\-]+"), enclosed, found(c, rf"{one_of(NUMBER_SIGNS)}\s*([A-Za-z0-9\-]{{4,}})\b"), license_number(c), found(c, r"(?i)\b([A-Z0-9]{2,3}-?\d{4,})\b"))


def certificates(pages: DataFrame, normal: bool = False, listed: bool = False) -> DataFrame:
    """(source, license_no, qualification, issue_date, expiry_date): one row for each text that has a number or a date.

    A period comes first: its end is the expiry, its start the issue. Days under labels fill what it leaves open; a label
    whose line holds a period has no day of its own. Without an expiry by then, the days with full years in the text do:
    the last is the expiry and the first the issue, if that is open; a single one is both.
    With listed also name (null for these), and one row for each other text with names: its first name, and the
    qualification that its word for a list stands for.
    """
    t = F.col("_t")
    out = worked_out(pages.select("source", plain("text", normal).alias("_t")))
    full = F.filter(F.transform(F.filter(date_tokens(t), lambda x: x.rlike(r"^\d{4}[^(]*$")), token_date), lambda d: d.isNotNull())
    kinds = read(sections(t, KIND_LABELS), kind=lambda label, v: F.nullif(F.trim(line_of(v, 120)), F.lit("")))
    days = read(sections(t, (*ISSUE_LABELS, *EXPIRY_LABELS, *PERIOD_LABELS)), period=lambda label, v: F.when(~among(label, ISSUE_LABELS), period(line_of(v, LINE))),
                day=lambda label, v: once(line_of(v, LINE), lambda x: F.when(~holds_period(x), first_day(F.substring(x, 1, NEAR)))))
    more = [F.try_element_at(names_in(t), F.lit(1)).alias("_person"), F.coalesce(*(F.when(t.contains(w), kind) for w, kind in LISTED_KIND.items())).alias("_listed")] if listed else []
    # each text is cut once, into columns of their own, before the expressions over them
    out = worked_out(out.select("source", certificate_number(t).alias("license_no"), first_of(kinds, KIND_LABELS, "kind").alias("qualification"), full.alias("_days"), days.alias("_found"), *more))
    out = worked_out(out.withColumns({"_period": first_of("_found", (*PERIOD_LABELS, *EXPIRY_LABELS), "period"), "_issue": first_of("_found", ISSUE_LABELS, "day"), "_expiry": first_of("_found", EXPIRY_LABELS, "day")}))
    out = worked_out(out.withColumns({"issue_date": F.coalesce("_period.start", "_issue"), "_until": F.coalesce("_period.end", "_expiry")}))
    out = out.withColumn("issue_date", F.coalesce("issue_date", F.when(F.col("_until").isNull(), F.array_min("_days")))).withColumn("expiry_date", F.coalesce("_until", F.array_max("_days")))
    some = F.coalesce("license_no", F.col("issue_date").cast("string"), F.col("expiry_date").cast("string")).isNotNull()
    if listed:
        out = out.withColumn("name", F.when(~some, F.col("_person"))).withColumn("qualification", F.coalesce("qualification", F.when(~some, F.col("_listed"))))
        return out.where(some | F.col("name").isNotNull()).select("source", "name", "license_no", "qualification", "issue_date", "expiry_date")
    return out.where(some).select("source", "license_no", "qualification", "issue_date", "expiry_date")


def newest(records: DataFrame) -> DataFrame:
    """The newest issue of each licence and expiry."""
    latest = F.struct(F.col("issue_date").isNull(), -F.unix_date("issue_date"), F.col("source"))
    return least_row(records, ["license_no", "expiry_date"], latest)


def redacted_lines(pages: DataFrame, normal: bool = False) -> DataFrame:
    """Lines that hold a label or a date word, with digits and letters masked."""
    lines = F.filter(F.split(plain("text", normal), "\n"), lambda x: x.rlike(one_of(LABELS)) | x.rlike(one_of(DATE_WORDS)))
    return pages.select("source", "page", F.array_join(F.transform(lines, redact), "\n").alias("text"))


def table_rows(rows: DataFrame, names_of: dict[str, str], normal: bool = False) -> DataFrame:
    """Extracted tables with known headers: licence numbers and days read from their cells."""
    out = rows.toDF(*(names_of.get(c, c) for c in rows.columns))
    if "license_no" in out.columns:
        out = out.withColumn("license_no", F.coalesce(license_number(plain("license_no", normal)), clean("license_no")))
    return out.withColumns({c: token_date(plain(c, normal)) for c in ("issue_date", "expiry_date") if c in out.columns})
