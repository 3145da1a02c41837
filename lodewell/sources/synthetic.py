"""A deterministic synthetic source of postings on spark.range: the same ordinal and seed give the same row, on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights and spellings of the synthetic postings.
NAME_FORMS = ("(주){}", "{}(주)", "{} 주식회사", "㈜{}", "{}")
INDUSTRIES = (("62", "컴퓨터 프로그래밍, 시스템 통합 및 관리업", 45), ("63", "정보서비스업", 20), ("58", "출판업(소프트웨어)", 12), ("64", "금융업", 8), ("47", "소매업(전자상거래)", 10), ("70", "연구개발업", 5))
REGIONS = (("11000", "서울특별시", 55), ("41000", "경기도", 20), ("26000", "부산광역시", 5), ("28000", "인천광역시", 4), ("30000", "대전광역시", 3), ("27000", "대구광역시", 3), ("29000", "광주광역시", 3), ("48000", "경상남도", 3), ("43000", "충청북도", 2), ("50000", "제주특별자치도", 2))
UNPAID = ("회사내규에 따름", "면접 후 결정", "협의 후 결정", "추후 협의")
OPEN = ("상시채용", "채용시까지", "채용시 마감")
SKILLS = ("Python", "Java", "JavaScript", "TypeScript", "Go", "Kotlin", "React", "Django", "MySQL", "PostgreSQL", "Redis", "Kafka", "Docker", "Kubernetes", "AWS", "Spark", "Airflow", "Git")
#: Other spellings of skills, by canonical name.
ALIASES = {"Python": "파이썬", "JavaScript": "js", "TypeScript": "ts", "Go": "golang", "Kotlin": "코틀린", "React": "react.js", "PostgreSQL": "postgres", "Kubernetes": "k8s", "Kafka": "apache kafka", "Spark": "apache spark"}
#: Sentences that name a skill which the posting does not ask for; none of them is part of the truth.
TRAPS = ("R&D 조직과 협업합니다", "C 레벨과 자주 소통합니다", "Go 사업부의 충원입니다", "Java 경험은 필수가 아닙니다", "Python 경험 무관")
NOISE = ("<br>", "&nbsp;", "&amp;", "\n\n\n", "※")
ROLES = ("백엔드", "프론트엔드", "풀스택", "모바일", "데이터엔지니어링", "데이터분석")
#: Chances: no body, with requirements, with preferences, open-ended deadline, a typo in a skill, another spelling, a trap.
BARE, NEEDS, LIKES, OPEN_SHARE, TYPO, ALIAS, TRAP = 0.07, 0.35, 0.8, 0.30, 0.02, 0.20, 0.3
#: Postings of one task at most.
ROWS = 250_000
EPOCH, COMPANIES, ID_PATTERN = "2026-09-15", 30, r"^SAMPLE-(\d{6})$"


def unit(seed: int, idx: Column, salt: str) -> Column:
    """A uniform number in [0, 1) of the seed, the row and what it is for."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), idx, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(u: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(u: Column, values: tuple, weights: tuple[int, ...]) -> Column:
    """A choice by cumulative weights."""
    at, total, out = 0, sum(weights), F.lit(values[-1])
    steps = []
    for v, w in zip(values[:-1], weights[:-1], strict=True):
        at += w
        steps.append((at / total, v))
    for edge, v in reversed(steps):
        out = F.when(u < edge, F.lit(v)).otherwise(out)
    return out


def typo(word: Column, u: Column) -> Column:
    """Two neighbouring letters of an ASCII word of four letters or more change places."""
    at = (F.floor(u * (F.length(word) - 2)) + 2).cast("int")
    swapped = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.lit(1)), F.substring(word, at, F.lit(1)), F.substring(word, at + 2, F.length(word)))
    return F.when((F.length(word) >= 4) & word.rlike(r"^\p{ASCII}+$") & (at < F.length(word)), swapped).otherwise(word)


def surface(skill: Column, u: Column) -> Column:
    """A skill as a posting writes it: by another spelling with the chance ALIAS, if it has one."""
    other = F.try_element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), skill)
    return F.when((u < ALIAS) & other.isNotNull(), other).otherwise(skill)


def canonical(form: Column) -> Column:
    """A spelling's canonical name; of an unknown one, itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (v, k)]), F.lower(form)), form)


def has_final(word: Column) -> Column:
    """Whether a word ends in a final consonant: Hangul by its code point, a Latin letter unless a, e, i, o, u or y, digits always."""
    last = F.right(word, F.lit(1))
    code = F.ascii(last)
    return F.when(code.between(0xAC00, 0xD7A3), (code - 0xAC00) % 28 != 0).when(last.rlike("[A-Za-z]"), ~F.lower(last).isin(*"aeiouy")).otherwise(last.rlike("[0-9]"))


def with_particle(word: Column, after_consonant: str, after_vowel: str) -> Column:
    """The word with the particle that its ending asks for."""
    return F.concat(word, F.when(has_final(word), after_consonant).otherwise(after_vowel))


def ordinal(source_id: Column, total: int) -> Column:
    """A row's ordinal from its id; null if there is no such row."""
    n = F.nullif(F.regexp_extract(source_id, ID_PATTERN, 1), F.lit("")).try_cast("long")
    return F.when(n.between(0, total - 1), n)


def postings(spark: SparkSession, total: int = 2_500, seed: int = 42) -> DataFrame:
    """(idx, source_id, payload, required, preferred): JSON payloads, with the skills that were really written into them."""
    idx = F.col("id")
    u = lambda salt: unit(seed, idx, salt)
    # skills in hash order stand for a shuffle
    hashed = F.array(*[F.struct(F.xxhash64(F.lit(seed).cast("long"), idx, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in SKILLS])
    shuffled = F.sort_array(hashed)["s"]
    base = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, -(-total // ROWS))).withColumn("shuffled", shuffled).withColumn("required", F.slice("shuffled", 1, F.floor(u("n") * 3).cast("int") + 2)).withColumn("preferred", F.array_except(F.slice("shuffled", 6, F.floor(u("m") * 3).cast("int") + 1), F.col("required")))
    name = F.format_string("가상회사%02d", F.floor(u("company") * COMPANIES))
    form = weighted(u("form"), NAME_FORMS, (1,) * len(NAME_FORMS))
    low = (F.floor(u("low") * 50) * 100 + 2_600).cast("long")
    pay = weighted(u("pay"), ("none", "range", "single"), (45, 40, 15))
    sal = F.when(pay == "none", pick(u("unpaid"), UNPAID)).when(pay == "range", F.concat(F.lit("연 "), low, F.lit("~"), low + 1_500, F.lit("만원"))).otherwise(F.concat(F.lit("연 "), low, F.lit("만원 이상")))
    career = weighted(u("career"), ("Z", "N", "E"), (15, 18, 67))
    years = (F.floor(u("years") * 9) + 1).cast("int")
    career_text = F.when(career == "Z", F.lit("경력무관")).when(career == "N", F.lit("신입")).otherwise(F.concat(F.lit("경력 "), years, F.lit("년 이상")))
    day = F.date_add(F.lit(EPOCH).cast("date"), F.floor(u("day") * 60).cast("int"))
    until = F.when(u("open") < OPEN_SHARE, pick(u("opened"), OPEN)).otherwise(F.date_format(day, "yyyy-MM-dd"))
    role = pick(u("role"), ROLES)
    shown = F.when(u("typo") < TYPO, typo(F.element_at("required", 1), u("at"))).otherwise(F.element_at("required", 1))
    chance = lambda s, salt: F.pmod(F.xxhash64(F.lit(seed).cast("long"), idx, s, F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    lines = F.array_join(F.transform("required", lambda s: F.concat(F.lit("- "), surface(s, chance(s, "alias")), F.lit(" 기반 기능 설계 및 구현"))), "\n")
    trap = F.when(u("trap") < TRAP, F.concat(F.lit("\n"), pick(u("which"), TRAPS))).otherwise(F.lit(""))
    body = F.when(u("bare") < BARE, F.lit("")).otherwise(F.concat(with_particle(role, "을", "를"), F.lit(" 맡습니다. "), shown, pick(u("noise"), NOISE), lines, trap))
    region, industry = (weighted(u(k), tuple(range(len(v))), tuple(x[2] for x in v)) for k, v in (("region", REGIONS), ("industry", INDUSTRIES)))
    name_of = lambda table, i, k: F.element_at(F.array(*[F.lit(x[k]) for x in table]), i + 1)
    source_id = F.format_string("SAMPLE-%06d", idx)
    wanted = F.struct(
        F.concat(role, F.lit(" 개발자")).alias("wantedTitle"),
        body.alias("jobCont"),
        F.when(u("needs") < NEEDS, F.concat(F.lit("- "), F.element_at("required", 1), F.lit(" 실무 경험"))).alias("certificate"),
        F.when((u("likes") < LIKES) & (F.size("preferred") > 0), F.concat(F.lit("- "), F.element_at("preferred", 1), F.lit(" 우대"))).alias("pfCond"),
        sal.alias("sal"),
        F.lit("Y").alias("salTpCd"),
        career_text.alias("enterTpNm"),
        career.alias("enterTpCd"),
        until.alias("receiptCloseDt"),
        weighted(u("edu"), ("00", "03", "04", "05", "06"), (30, 10, 15, 40, 5)).alias("minEdubgIcd"),
        weighted(u("emp"), ("10", "11", "20", "4"), (80, 5, 12, 3)).alias("empTpCd"),
        role.alias("jobsNm"),
        name_of(REGIONS, region, 0).alias("regionCd"),
        name_of(REGIONS, region, 1).alias("workRegion"),
        F.concat(F.lit("https://example.invalid/"), source_id).alias("dtlRecrContUrl"),
        F.struct(F.slice("required", 1, 3).alias("srchKeywordNm")).alias("keywordList"),
    )
    corp = F.struct(F.replace(form, F.lit("{}"), name).alias("corpNm"), name_of(INDUSTRIES, industry, 1).alias("indTpCdNm"), pick(u("size"), ("대기업", "중견기업", "중소기업")).alias("busiSize"))
    contact = F.struct(F.lit("02-000-0000").alias("contactTelno"))
    payload = F.to_json(F.struct(source_id.alias("wantedAuthNo"), F.date_format(F.date_sub(F.lit(EPOCH).cast("date"), F.floor(u("reg") * 30).cast("int")), "yyyy-MM-dd").alias("regDt"), corp.alias("corpInfo"), wanted.alias("wantedInfo"), contact.alias("empchargeInfo")))
    # the truth: skills that can be found in the text or the keywords
    return base.select(idx.alias("idx"), source_id.alias("source_id"), payload.alias("payload"), F.slice("required", 1, 3).alias("required"), F.when((u("likes") < LIKES) & (F.size("preferred") > 0), F.slice("preferred", 1, 1)).otherwise(F.array().cast("array<string>")).alias("preferred"))


def ground_truth(spark: SparkSession, total: int = 2_500, seed: int = 42, source_id: str | None = None) -> DataFrame:
    """(source_id, required, preferred): the skills that were written into the postings, of one id if it is given. Only the columns that the truth needs are computed."""
    truth = postings(spark, total, seed).select("source_id", "required", "preferred")
    return truth if source_id is None else truth.where(F.col("source_id") == source_id)
