"""Column expressions over text: emptiness, keys, names, ids, positions, escapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mean "no value" when they are all a cell holds.
EMPTY_WORDS = ("", "nan", "none", "null", "na", "<na>")
LONGEST_EMPTY_WORD = max(map(len, EMPTY_WORDS))
#: The characters with Unicode's property White_Space, which the expressions' (?U)\\s stands for too.
WHITE_SPACE = "".join(chr(x) for x in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# How positions of work are written, by position, in the order in which they are labelled.
POSITIONS = ("flat", "horizontal", "vertical", "overhead")
POSITION_WORDS = {"flat": ("下向",), "horizontal": ("横向", "水平"), "vertical": ("立向", "縦向"), "overhead": ("上向",)}
POSITION_CODES = {"flat": "1", "horizontal": "2", "vertical": "3", "overhead": "4"}
POSITION_TOKENS = {"flat": "F", "horizontal": "H", "vertical": "V", "overhead": "OH"}
POSITION_LABELS = {"flat": "下向", "horizontal": "横向", "vertical": "立向", "overhead": "上向"}
EVERY_POSITION = "全姿勢"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out a single time, however often f names it.

    Without it an expression over expressions doubles at every level, until the generated code is too long to be compiled.
    """
    return F.element_at(F.transform(F.array(value), f), 1)


def trimmed(c: Column | str) -> Column:
    """The text without white space at its ends. Trimming takes a fraction of the time of an expression that does the same."""
    return F.trim(col(c).cast("string"), F.lit(WHITE_SPACE))


def untrimmed(t: Column) -> Column:
    """Whether a text's first and last characters are such that trimming cannot change it: visible ASCII, or behind all
    white space. A comparison takes a fraction of the time of trimming by a list of characters."""
    visible = lambda x: ((x >= "!") & (x < "\x7f")) | (x >= chr(ord(WHITE_SPACE[-1]) + 1))
    return visible(t) & visible(F.substring(t, -1, 1))


def clean(c: Column | str) -> Column:
    """The trimmed text, or null where it means "no value"."""
    valued = lambda t: F.when((F.length(t) > LONGEST_EMPTY_WORD) | ~among(F.lower(t), EMPTY_WORDS), t)
    made = lambda t: F.when(untrimmed(t), valued(t)).otherwise(once(trimmed(t), valued))
    # a column is at hand, however often it is named; other expressions are worked out once
    return made(F.col(c).cast("string")) if isinstance(c, str) else once(c.cast("string"), made)


def either(*cs: Column | str) -> Column:
    """The first of several columns that has a value."""
    return F.coalesce(*(clean(c) for c in cs))


def among(c: Column, words: Sequence[str]) -> Column:
    """Whether a text is one of these. Within lambdas, which Spark interprets, isin takes many times as long."""
    return F.array_contains(F.array(*map(F.lit, words)), c)


def strip_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(trimmed(c), r"(?U)\s+", " ")


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility composition; Spark has no such function, so texts that are not ASCII go through Arrow in batches."""
    text = col(c).cast("string")
    return F.coalesce(_nfkc(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def license_key(c: Column | str, normal: bool = False) -> Column:
    """Upper case without white space or hyphens; normal: the text needs no NFKC (it is known to be ASCII)."""
    return F.regexp_replace(F.upper(col(c).cast("string") if normal else nfkc(c)), r"(?U)[\s-]", "")


def name_key(c: Column | str, normal: bool = False) -> Column:
    return F.regexp_replace(col(c).cast("string") if normal else nfkc(c), r"(?U)\s", "")


def clean_name(c: Column | str) -> Column:
    """A name without white space; null if it has no letter, more than 30 % digits, or only digits and punctuation."""
    count = lambda t, kind: F.length(F.regexp_replace(t, rf"[^\p{{{kind}}}]", ""))
    return once(F.regexp_replace(clean(c), r"(?U)\s", ""), lambda t: F.when((count(t, "L") > 0) & (count(t, "Nd") * 10 <= F.length(t) * 3), t))


def whole_number(c: Column | str) -> Column:
    """Ids read as decimals ('12.0') without their fraction; other text as it is."""

    def whole(text: Column) -> Column:
        # most ids are plain digits without leading zeros, which need no number made of them
        plain, number = text.rlike(r"^(?:0|[1-9]\d{0,14})$"), text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        value = text.try_cast("double")
        return F.when(plain, text).when(number & (F.abs(value) < 1e15) & (value == F.floor(value)), value.cast("long").cast("string")).otherwise(text)

    return once(clean(c), whole)


def person_key(name: Column, employee_id: Column, license_no: Column, qualification: Column, expiry: Column, normal: bool = False) -> Column:
    """emp:, name:, lic: or anon: key of a person, from the first of these that is known."""
    anon = F.substring(F.sha1(F.concat_ws("|", F.coalesce(clean(qualification), F.lit("")), F.coalesce(clean(expiry), F.lit("")))), 1, 16)
    return F.coalesce(
        F.concat(F.lit("emp:"), whole_number(employee_id)), F.concat(F.lit("name:"), clean(name_key(clean(name), normal))),
        F.concat(F.lit("lic:"), clean(license_key(clean(license_no), normal))), F.concat(F.lit("anon:"), anon))


def row_license_key(license_no: Column, person: Column, qualification: Column, expiry: Column, issue: Column, normal: bool = False) -> Column:
    """lic: key of a licence number, or derived: from what else identifies the licence."""
    parts = [F.coalesce(clean(c), F.lit("")) for c in (person, qualification, expiry, issue)]
    return F.coalesce(F.concat(F.lit("lic:"), clean(license_key(whole_number(license_no), normal))), F.concat(F.lit("derived:"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)))


def record_key(name: Column | str, license_no: Column | str, qualification: Column | str, normal: bool = False) -> Column:
    """Name key, licence and qualification in lower case, joined by |; null as empty."""
    text = lambda c: F.coalesce(F.lower(clean(c)), F.lit(""))
    return F.concat_ws("|", F.coalesce(name_key(clean(name), normal), F.lit("")), text(license_no), text(qualification))


def star_person_id(name: Column | str, birth: Column | str, row_no: Column | str) -> Column:
    return F.sha1(F.when(clean(name).isNotNull(), F.concat_ws("|", F.lower(clean(name)), F.coalesce(clean(birth), F.lit("")))).otherwise(F.concat(F.lit("row:"), col(row_no).cast("string"))))


def star_license_id(license_no: Column | str, row_no: Column | str) -> Column:
    return F.sha1(F.coalesce(F.lower(clean(license_no)), F.concat(F.lit("row:"), col(row_no).cast("string"))))


def positions(c: Column | str) -> dict[str, Column]:
    """For each position whether a text names it: by word, by code such as 3G, or by a token between separators."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    tokens = F.split(F.upper(text), r"(?U)[\s,/、]+")
    every = text.contains(EVERY_POSITION)
    found = {}
    for p in POSITIONS:
        tests = [text.contains(w) for w in POSITION_WORDS[p]] + [F.lower(text).contains(p), text.rlike(rf"(?i)\b{POSITION_CODES[p]}\s*[FG]\b"), F.array_contains(tokens, POSITION_TOKENS[p])]
        if p == "vertical":
            tests.append(text.contains("縦") & text.contains("向"))
        found[p] = every | reduce(or_, tests)
    return found


def position_columns(c: Column | str) -> dict[str, Column]:
    """pos_<name> flags (0 or 1), positions_jp, positions_en, positions_code and position_count."""
    found = positions(c)
    every = reduce(lambda a, b: a & b, found.values())
    label = lambda text, whole: F.when(every, F.lit(whole)).otherwise(F.concat_ws("/", *(F.when(found[p], F.lit(text[p])) for p in POSITIONS)))
    out = {f"pos_{p}": found[p].cast("int") for p in POSITIONS}
    out["positions_jp"] = label(POSITION_LABELS, EVERY_POSITION)
    out["positions_en"] = label({p: p for p in POSITIONS}, "all")
    out["positions_code"] = label(POSITION_TOKENS, "F/H/V/OH")
    out["position_count"] = reduce(lambda a, b: a + b, (found[p].cast("int") for p in POSITIONS))
    return out


def ics_escape(c: Column | str) -> Column:
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    for plain, escaped in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def slug(c: Column | str, length: int = 48) -> Column:
    """A token that is safe in file names, of `length` characters at most."""
    text = F.regexp_replace(F.coalesce(clean(c), F.lit("")), r"(?U)[^\w.-]+", "-")
    return F.substring(F.regexp_replace(text, r"^[-.]+|[-.]+$", ""), 1, length)


def redact(c: Column | str) -> Column:
    """Digits as 0 and Latin letters as X."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\p{Nd}", "0"), "[A-Za-z]", "X")
