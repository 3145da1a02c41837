"""Skill dictionaries: validation, extraction from text, demand statistics and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.schemas import CATEGORIES

#: Lines that name a skill without asking for it.
NEGATED = r"필수가 아닙니다|무관|필요 ?없|(?i)not required"
#: Words of the longest surface form that is looked for.
LONGEST_FORM = 5
#: Forms of a dictionary that go to every executor whole.
MOST_BROADCAST = 1_000_000
#: Forms that are listed in the plan, so that other words of texts are left out before the join.
MOST_LISTED = 2_000
#: Matches of one task of united, for which it holds an aggregate each in memory at most.
ROWS = 500_000


def validate(skills: DataFrame) -> DataFrame:
    """(problem, name): names that occur twice, categories that there are none of, aliases owned twice, aliases equal to their own name."""
    alias = skills.select("name", F.explode("aliases").alias("alias")).withColumn("alias", F.lower("alias"))
    found = [
        skills.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_name").alias("problem"), "name"),
        skills.where(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))).select(F.lit("unknown_category").alias("problem"), "name"),
        alias.groupBy("alias").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("alias_taken").alias("problem"), F.col("alias").alias("name")),
        alias.where(F.col("alias") == F.lower("name")).select(F.lit("alias_is_name").alias("problem"), "name"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def surface_forms(skills: DataFrame) -> DataFrame:
    """(form, skill): lower-cased names and aliases of skills without patterns of their own."""
    plain = skills.where(F.coalesce(F.size("match_patterns"), F.lit(0)) <= 0)
    return plain.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"), F.col("name").alias("skill")).select(F.lower("form").alias("form"), "skill").distinct()


def words(c: Column) -> Column:
    """Every word of a text, lower-cased: letters, digits and the signs that names of skills hold; a sign that ends a sentence is no part."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[\w+#][\w+#.\-]*"), F.lit(0))
    return F.transform(raw, lambda x: F.rtrim(x, F.lit(".-")))


def without_negations(c: Column, pattern: str = NEGATED) -> Column:
    """A text without the lines that say that something is not asked for; what they name is no match."""
    text = F.coalesce(c, F.lit(""))
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")
    # NEGATED has no anchors, so a text without a match has no line with one
    return F.when(text.rlike(pattern), rest).otherwise(text) if pattern == NEGATED else rest


def phrases(c: Column, longest: int) -> Column:
    """Every run of one to `longest` words of a text, joined by one space."""
    runs = lambda n: F.transform(F.slice(c, F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(c, i + k) for k in range(1, n)]))
    return c if longest == 1 else F.when(F.size(c) > 0, F.flatten(F.array(c, *[runs(n) for n in range(2, longest + 1)]))).otherwise(c)


def word_hits(texts: DataFrame, keys: list[str], column: str, skills: DataFrame, longest: int | None = None) -> DataFrame:
    """(keys, skill), a row for each occurrence: an equi-join of the texts' words and runs of words with the dictionary's forms.

    Forms are cut into words as texts are, so forms of several words match too, up to `longest` of them (the
    dictionary's longest, LONGEST_FORM at most); a form inside a longer one counts as well. Up to MOST_BROADCAST forms
    are broadcast, whatever the optimizer takes the sides' sizes to be: words of texts are never collected or shuffled
    then, and so a common word is no large group. It is left to the optimizer beyond that.
    """
    forms = surface_forms(skills).select(F.array_join(words(F.col("form")), " ").alias("form"), "skill").where("form <> ''").distinct()
    size = forms.agg(F.max(F.size(F.split("form", " "))).alias("longest"), F.count("*").alias("n")).first()
    longest = longest or min(LONGEST_FORM, size["longest"] or 1)
    runs = phrases(F.col("__words"), longest)
    if size["n"] <= MOST_LISTED:  # no runs but in texts with a word that begins one, and no other words
        known = sorted({r["form"] for r in forms.collect()})
        heads = sorted({f.split(" ")[0] for f in known if " " in f})
        runs = F.when(F.arrays_overlap("__words", F.array(*map(F.lit, heads))), runs).otherwise(F.col("__words")) if heads else F.col("__words")
        runs = F.filter(runs, lambda x: x.isin(known))
    found = texts.withColumn("__words", words(F.col(column))).select(*keys, F.explode(runs).alias("form"))
    return found.join(F.broadcast(forms) if size["n"] <= MOST_BROADCAST else forms, "form").select(*keys, "skill")


def match_words(texts: DataFrame, key: str, column: str, skills: DataFrame, longest: int | None = None) -> DataFrame:
    """(key, skill, occurrences) of word_hits; only matches are ever shuffled."""
    return word_hits(texts, [key], column, skills, longest).groupBy(key, "skill").agg(F.count("*").alias("occurrences"))


def match_patterns(texts: DataFrame, key: str | list[str], column: str, patterns: dict[str, str]) -> DataFrame:
    """The same by a regex for each skill (Java syntax, look-around allowed): one pass over the texts."""
    keys = [key] if isinstance(key, str) else key
    hits = [F.struct(F.lit(k).alias("skill"), F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(p)).cast("long").alias("occurrences")) for k, p in patterns.items()]
    return texts.select(*keys, F.explode(F.filter(F.array(*hits), lambda x: x["occurrences"] > 0)).alias("x")).select(*keys, "x.*")


def job_skills(required: DataFrame, preferred: DataFrame, key: str, extracted_by: str = "dict_v1", confidence: Column | None = None) -> DataFrame:
    """(key, skill, is_required, occurrences, confidence, extracted_by) of matches in the required and the preferred part.

    A skill of both parts is required. confidence is 1 unless given as an expression of the other columns; it is kept within 0 and 1.
    """
    return united(required.withColumn("is_required", F.lit(True)).unionByName(preferred.withColumn("is_required", F.lit(False))), key, extracted_by, confidence)


def shares(df: DataFrame, rows: int) -> int:
    """The number of partitions in which about ROWS of the rows are in each, whatever number shuffles have."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def united(hits: DataFrame, key: str, extracted_by: str = "dict_v1", confidence: Column | None = None, partitions: int | None = None) -> DataFrame:
    """job_skills of (key, skill, is_required, occurrences) in any number of rows for each skill.

    With `partitions` (see shares) the rows are dealt by key before anything is aggregated, so that a task's memory does not grow with the input.
    """
    hits = hits if partitions is None else hits.repartition(partitions, key)
    found = hits.groupBy(key, "skill").agg(F.max("is_required").alias("is_required"), F.sum("occurrences").alias("occurrences"))
    sure = F.lit(1.0) if confidence is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return found.withColumns({"confidence": sure.cast("float"), "extracted_by": F.lit(extracted_by)})


def extract(jobs: DataFrame, dictionary: DataFrame, key: str = "source_id", extracted_by: str = "dict_v1") -> DataFrame:
    """job_skills of flat postings (see normalize): the dictionary's forms and patterns in the tasks and requirements, which are required, and in the preferences. Negated lines do not count; of a skill with patterns only these are looked for.

    Both parts are taken in one pass over the postings, and the matches are counted once.
    """
    patterns = {r["name"]: "|".join(f"(?:{p})" for p in r["match_patterns"]) for r in dictionary.where(F.size("match_patterns") > 0).select("name", "match_patterns").collect()}
    part = lambda required, text: F.struct(F.lit(required).alias("is_required"), without_negations(text).alias("__text"))
    parts = F.array(part(True, F.concat_ws("\n", "sections.main_tasks", "sections.requirements")), part(False, F.col("sections.preferred")))
    texts, keys = jobs.select(key, F.explode(parts).alias("x")).select(key, "x.*"), [key, "is_required"]
    hits = word_hits(texts, keys, "__text", dictionary).withColumn("occurrences", F.lit(1).cast("long"))
    return united(hits.unionByName(match_patterns(texts, keys, "__text", patterns)) if patterns else hits, key, extracted_by)


def jobs_with(jobs: DataFrame, found: DataFrame, key: str, skill: str, required: bool | None = True) -> DataFrame:
    """The reverse lookup: postings that ask for a skill (required only, preferred only with False, either with None)."""
    hits = found.where(F.col("skill") == skill)
    hits = hits if required is None else hits.where(F.col("is_required") == required)
    return jobs.join(hits.select(key), key, "left_semi")


def by_alias(skills: DataFrame, alias: str) -> DataFrame:
    """Skills that own an alias, in whatever case."""
    return skills.where(F.array_contains(F.transform("aliases", F.lower), alias.lower()))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Micro-averaged precision and recall of (key, skills) arrays against (key, skills)."""
    j = found.select("key", F.col("skills").alias("f")).join(truth.select("key", F.col("skills").alias("t")), "key", "full_outer")
    none = F.array().cast("array<string>")
    f, t = F.coalesce("f", none), F.coalesce("t", none)
    hit = F.sum(F.size(F.array_intersect(f, t)))
    return j.agg(F.round(hit / F.nullif(F.sum(F.size(f)), F.lit(0)), 4).alias("precision"), F.round(hit / F.nullif(F.sum(F.size(t)), F.lit(0)), 4).alias("recall"))


def market_stats(rows: DataFrame, group: str | list[str], skill: str, required: Column, pay: str) -> DataFrame:
    """For each group (a category, or a day and a category) and skill: postings, required_count, avg_pay, and the rank by postings in the group."""
    group = [group] if isinstance(group, str) else group
    stats = rows.groupBy(*group, skill).agg(F.count("*").alias("postings"), F.count_if(required).alias("required_count"), F.round(F.avg(pay), 4).alias("avg_pay"))
    return stats.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("postings"))))


def skill_gap(demand: DataFrame, held: DataFrame, skill: str, n: int) -> DataFrame:
    """The n most demanded skills that are not held."""
    return demand.join(held.select(skill).distinct(), skill, "left_anti").groupBy(skill).agg(F.count("*").alias("demand")).orderBy(F.desc("demand"), skill).limit(n)
