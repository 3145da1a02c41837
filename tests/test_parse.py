"""Golden values of the field parsers."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lodewell.functions import parse


def values(spark, rows, make, schema="a string, b string"):
    """make's values for all rows, by one plan."""
    n = len(rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").coalesce(1)
    got = {r.i: r.x for r in df.select("i", make(F.col("a"), F.col("b")).alias("x")).collect()}
    return [tuple(got[i]) if isinstance(got[i], tuple) else got[i] for i in range(n)]


def one(spark, rows, make):
    return values(spark, [(r, None) for r in rows], lambda a, b: make(a))


def test_company_key(spark):
    same = ["(주)카카오", "카카오(주)", "카카오 주식회사", "㈜카카오", "카카오", " 카카오 ", "카카오　"]
    assert one(spark, same, parse.company_key) == ["카카오"] * len(same)
    assert one(spark, [None, "", "(주)"], parse.company_key) == ["", "", ""]


def test_clean_text(spark):
    a, b, c, d, e = one(spark, ["주요업무<br>- 개발&nbsp;업무\n\n\n\n우대사항", None, "&amp;lt;b&gt;", "a <p\nclass=x> b", "　x \t"], parse.clean_text)
    assert a == "주요업무 - 개발 업무\n\n우대사항" and b == "" and c == "<b>" and d == "a b" and e == "x"


SALARIES = [
    (("연 6,900~8,500만원", "Y"), (69_000_000, 85_000_000, None)),
    (("연 3600만원 이상", "Y"), (36_000_000, None, None)),
    (("월 266만원", "M"), (31_920_000, None, None)),
    (("월 266만원", None), (31_920_000, None, None)),
    (("회사내규에 따름", "Y"), (None, None, "no_number:회사내규에 따름")),
    (("시급 12,000원", "H"), (None, None, "hourly:시급 12,000원")),
    (("12,000원", "h"), (None, None, "hourly:12,000원")),
    (("일급 9만원", ""), (None, None, "daily:일급 9만원")),
    ((None, None), (None, None, "empty")),
    (("  ", "Y"), (None, None, "empty")),
    (("1~3~2", "Y"), (10_000, 30_000, None)),
    (("９００만원", "Y"), (9_000_000, None, None)),
    (("99999999999999999999", "Y"), (None, None, "overflow:99999999999999999999")),
]


def test_salary(spark):
    assert values(spark, [a for a, _ in SALARIES], parse.salary) == [b for _, b in SALARIES]


EXPERIENCE = [
    (("경력무관", "Z"), (0, None, None)),
    (("경력 무관", ""), (0, None, None)),
    (("신입/경력", ""), (0, None, None)),
    (("신입 채용", "N"), (0, 0, None)),
    (("3~7년", "E"), (3, 7, None)),
    (("경력 24개월 이상", "E"), (2, None, None)),
    (("30개월", "E"), (2, None, None)),
    (("7년차 이상", "E"), (7, None, None)),
    (("담당자 문의", "E"), (None, None, "unparsed:담당자 문의")),
    (("3년~7년", "E"), (3, None, None)),
    (("1년 6개월", "E"), (0, None, None)),
    (("", "E"), (None, None, "unparsed:")),
    ((None, None), (None, None, "unparsed:")),
    (("99999~3년", "E"), (None, 3, None)),
]


def test_experience(spark):
    assert values(spark, [a for a, _ in EXPERIENCE], parse.experience) == [b for _, b in EXPERIENCE]


DEADLINES = [
    ("2026-10-21", (date(2026, 10, 21), None)),
    ("2026.10.21", (date(2026, 10, 21), None)),
    ("2026/10/21", (date(2026, 10, 21), None)),
    ("2026-9-1", (date(2026, 9, 1), None)),
    ("상시채용", (None, "open_ended")),
    ("채용시까지", (None, "open_ended")),
    ("2026-10-21 채용시 마감", (None, "open_ended")),
    ("2026-13-45", (None, "invalid_date:2026-13-45")),
    ("2026-02-30", (None, "invalid_date:2026-02-30")),
    ("0000-01-01", (None, "invalid_date:0000-01-01")),
    ("미정", (None, "unparsed:미정")),
    (None, (None, "empty")),
]


def test_deadline(spark):
    assert one(spark, [a for a, _ in DEADLINES], parse.deadline) == [b for _, b in DEADLINES]


@pytest.mark.parametrize("make, rows, want", [(parse.education, ["04", "00", " 05 ", "99", None], ["college", "none", "bachelor", None, None]), (parse.employment, ["10", "20", "21", "4", "ZZ", None], ["fulltime", "contract", "contract", "dispatch", None, None])])
def test_codes(spark, make, rows, want):
    assert one(spark, rows, make) == want


def test_lenient_date(spark):
    assert one(spark, ["2026-09-01", "2026-9-1", "2026-02-30", "x", None], parse.lenient_date) == [date(2026, 9, 1), date(2026, 9, 1), None, None, None]
