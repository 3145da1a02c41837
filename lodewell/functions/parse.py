"""Parsers of posting fields as Column expressions. None of them fails on a value: what can't be read is null, with a note."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the postings' source.
EDUCATION = {"00": "none", "01": "elementary", "02": "middle", "03": "highschool", "04": "college", "05": "bachelor", "06": "master", "07": "phd"}
EMPLOYMENT = {"10": "fulltime", "11": "parttime", "20": "contract", "21": "contract", "4": "dispatch"}
#: Legal forms in company names, entities in the order of their replacement, words for no fixed deadline.
CORPORATE_FORMS = ("(주)", "㈜", "주식회사", "(유)", "유한회사", "(재)", "재단법인")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
OPEN_ENDED = ("상시", "채용시", "수시")
#: Unicode white space.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Patterns of numbers in salaries, of spans, months and years of experience, and of dates.
NUMBER = r"\d[\d,]*"
YEAR_SPAN, MONTH_COUNT, YEAR_COUNT = r"(\d+)\s*[~\-–]\s*(\d+)\s*년", r"(\d+)\s*개월", r"(\d+)\s*년"
DATE = r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})"

WON, MONTHS = 10_000, 12


def quoted(words: tuple[str, ...]) -> str:
    return "|".join(f"\\Q{w}\\E" for w in words)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(c, F.lit(WHITE))


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def replaced(c: Column, pattern: str, by: str, *signs: str) -> Column:
    """regexp_replace, tried only on texts that hold one of the signs without which the pattern can't match."""
    return bound(c, lambda x: F.when(reduce(or_, [x.contains(s) for s in signs]), F.regexp_replace(x, pattern, by)).otherwise(x))


def digits(c: Column) -> Column:
    """Full-width digits as ASCII ones."""
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def note(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.left(text, F.lit(20)))


def clean_text(c: Column) -> Column:
    """HTML remnants out: tags become spaces, then entities are decoded, runs of blank lines and blanks shrink, ends are stripped."""
    out = replaced(blank_if_null(c), "<[^>]+>", " ", "<")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(replaced(replaced(out, r"\n{3,}", "\n\n", "\n\n\n"), r"[ \t]{2,}", " ", "  ", "\t"))


def company_key(c: Column) -> Column:
    """A company's name without legal form and white space; never null."""
    return F.translate(F.regexp_replace(blank_if_null(c), quoted(CORPORATE_FORMS), ""), WHITE, "")


def salary(raw: Column, code: Column) -> Column:
    """struct(min, max, note): yearly won. The text is in 10,000 won, by the month if it or the code says so; max only of two numbers or more."""
    code = F.upper(blank_if_null(code))

    def amounts(text: Column) -> Column:
        found = F.regexp_extract_all(digits(text), F.lit(NUMBER), F.lit(0))
        factor = F.when(text.contains("월") | (code == "M"), F.lit(WON * MONTHS)).otherwise(F.lit(WON)).cast("bigint")
        return F.transform(found, lambda x: F.try_multiply(F.replace(x, F.lit(","), F.lit("")).try_cast("bigint"), factor))

    def reason(text: Column, won: Column) -> Column:
        return (
            F.when(text == "", F.lit("empty"))
            .when(F.size(won) == 0, note("no_number", text))
            .when(text.contains("시급") | (code == "H"), note("hourly", text))
            .when(text.contains("일급") | (code == "D"), note("daily", text))
            .when(F.exists(won, lambda x: x.isNull()), note("overflow", text))
        )

    def read(won: Column, why: Column) -> Column:
        fine = why.isNull()
        return F.struct(F.when(fine, F.array_min(won)).alias("min"), F.when(fine & (F.size(won) > 1), F.array_max(won)).alias("max"), why.alias("note"))

    return bound(strip(blank_if_null(raw)), lambda text: bound(amounts(text), lambda won: bound(reason(text, won), lambda why: read(won, why))))


def group(c: Column, pattern: str, i: int) -> Column:
    """A regex group of the first match; null without one."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def experience(raw: Column, code: Column) -> Column:
    """struct(min, max, note): years asked for. Anyone may apply: (0, null); beginners: (0, 0); months are divided down."""
    code = F.upper(blank_if_null(code))
    small = lambda c: c.try_cast("smallint")
    zero, none = F.lit(0).cast("smallint"), F.lit(None).cast("smallint")

    def stated(plain: Column) -> Column:
        return F.struct(group(plain, YEAR_SPAN, 1).alias("low"), group(plain, YEAR_SPAN, 2).alias("high"), group(plain, MONTH_COUNT, 1).alias("months"), group(plain, YEAR_COUNT, 1).alias("years"))

    def read(text: Column, x: Column) -> Column:
        least = F.when(x["low"].isNotNull(), small(x["low"])).when(x["months"].isNotNull(), small(F.floor(x["months"].try_cast("bigint") / MONTHS))).when(x["years"].isNotNull(), small(x["years"]))
        unread = F.coalesce(x["low"], x["months"], x["years"]).isNull()
        return F.struct(least.alias("min"), F.when(x["low"].isNotNull(), small(x["high"])).alias("max"), F.when(unread, note("unparsed", text)).alias("note"))

    def of(text: Column) -> Column:
        anyone = (code == "Z") | text.contains("무관") | text.contains("신입/경력")
        beginner = (code == "N") | text.contains("신입")
        fixed = lambda most: F.struct(zero.alias("min"), most.alias("max"), F.lit(None).cast("string").alias("note"))
        return F.when(anyone, fixed(none)).when(beginner, fixed(zero)).otherwise(bound(digits(text), lambda plain: bound(stated(plain), lambda x: read(text, x))))

    return bound(strip(blank_if_null(raw)), of)


def deadline(raw: Column) -> Column:
    """struct(date, note): open-ended deadlines are a normal null."""

    def read(text: Column, found: Column, day: Column) -> Column:
        reason = F.when(text == "", F.lit("empty")).when(text.rlike(quoted(OPEN_ENDED)), F.lit("open_ended")).when(found.isNull(), note("unparsed", text)).when(day.isNull(), note("invalid_date", text))
        return bound(reason, lambda why: F.struct(F.when(why.isNull(), day).alias("date"), why.alias("note")))

    # the first date, whatever separates its parts
    day = lambda found: F.when(F.left(found, F.lit(4)) != "0000", F.try_to_date(F.translate(found, "./", "--"), "yyyy-M-d"))
    return bound(strip(blank_if_null(raw)), lambda text: bound(group(digits(text), DATE, 0), lambda found: bound(day(found), lambda d: read(text, found, d))))


def lookup(code: Column, names: dict[str, str]) -> Column:
    """A code's name; null for null or unknown codes."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(pairs, strip(blank_if_null(code)))


def education(code: Column) -> Column:
    return lookup(code, EDUCATION)


def employment(code: Column) -> Column:
    return lookup(code, EMPLOYMENT)


def lenient_date(c: Column) -> Column:
    """yyyy-M-d; anything else is null."""
    return F.try_to_date(c.cast("string"), "yyyy-M-d")
