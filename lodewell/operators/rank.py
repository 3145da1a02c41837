"""Top-k, fused ranks, match features and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewell.functions.parse import EDUCATION
from lodewell.functions.search import cosine, trigram_similarity

#: Rank fusion's constant.
RRF_K = 60
#: Weights of what a user did with a posting.
LABELS = {"apply": 3, "save": 2, "view": 1, "dismiss": 0}


def top_k_cosine(vectors: DataFrame, query: Column, k: int, digits: int = 4) -> DataFrame:
    """The k vectors of largest cosine (rounded, ties to the smaller id): a map and a top-k, no full sort."""
    return vectors.select("vec_id", F.round(cosine(F.col("embedding"), query), digits).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(k)


def fuse(left: DataFrame, right: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two short lists (key, rank)."""
    j = left.select(key, F.col("rank").alias("a")).join(right.select(key, F.col("rank").alias("b")), key, "full_outer")
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    return j.select(key, F.round(part("a") + part("b"), 6).alias("score"))


def label_weight(action: Column, seconds: Column) -> Column:
    """What an interaction tells: a view counts from 10 seconds on."""
    return F.when(action == "apply", 3).when(action == "save", 2).when((action == "view") & (seconds > 10), 1).otherwise(0)


#: Levels of education in rising order, as the parser names them; what a posting asks for is met by the same level or a higher one.
EDUCATION_LEVELS = tuple(name for _, name in sorted(EDUCATION.items()) if name != "none")
#: Years outside the asked range at which the fit has fallen to 1 / e.
YEARS_DECAY = 3.0


def share(want: Column, held: Column) -> Column:
    return F.when(F.size(want) > 0, F.size(F.array_intersect(want, held)) / F.size(want)).otherwise(F.lit(1.0))


def education_level(name: Column) -> Column:
    """Place among EDUCATION_LEVELS from 1; null for none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, EDUCATION_LEVELS)), name), F.lit(0))


def match_features(required: Column, preferred: Column, held: Column) -> list[Column]:
    """The features that need skills alone."""
    return [share(required, held).alias("required_share"), share(preferred, held).alias("preferred_share"), F.array_except(required, held).alias("missing_required")]


def features(today: Column) -> dict[str, Column]:
    """The thirteen match features by name, over the columns of a joined pair of a profile and a posting.

    Profile: held (array of names), levels (map name -> 0 to 1), years, profile_education, wanted_regions (array),
    desired_salary, profile_vector, wanted_title. Posting: required, preferred (arrays), weights (map name -> weight),
    exp_min, exp_max, education, region_code, salary_min, job_vector, title, views, deadline.
    Unknown sides leave a feature null; no education or region asked for is met by all.
    """
    c = F.col
    asked = F.map_entries("weights")
    got = F.aggregate(asked, F.lit(0.0), lambda s, e: s + F.coalesce(F.try_element_at(c("levels"), e["key"]).cast("double"), F.lit(0.0)) * e["value"].cast("double"))
    total = F.aggregate(asked, F.lit(0.0), lambda s, e: s + e["value"].cast("double"))
    low, high = F.coalesce("exp_min", F.lit(0)), c("exp_max")
    outside = F.when(c("years") < low, low - c("years")).when(c("years") > high, c("years") - high).otherwise(0)
    return {
        "skill_required_coverage": share(c("required"), c("held")),
        "skill_preferred_coverage": share(c("preferred"), c("held")),
        "skill_weighted_score": F.when(total > 0, got / total),
        "missing_required_count": F.size(F.array_except("required", "held")),
        "exp_gap": c("years") - c("exp_min"),
        "exp_fit": F.when(c("years").isNotNull(), F.exp(-outside / F.lit(YEARS_DECAY))),
        "education_fit": F.when(education_level(c("education")).isNull(), 1).when(education_level(c("profile_education")) >= education_level(c("education")), 1).otherwise(0),
        "region_match": F.when((F.size("wanted_regions") == 0) | F.array_contains("wanted_regions", c("region_code")), 1).otherwise(0),
        "salary_gap_ratio": F.when(c("desired_salary") > 0, (c("salary_min") - c("desired_salary")) / c("desired_salary")),
        "semantic_similarity": cosine(c("profile_vector"), c("job_vector")),
        "title_similarity": trigram_similarity(c("wanted_title"), c("title")),
        "job_popularity": F.log1p(F.coalesce("views", F.lit(0)).cast("double")),
        "days_until_deadline": F.datediff("deadline", today),
    }


def candidates(jobs: DataFrame, vector: Column, *, regions: tuple[str, ...] = (), years: int | None = None, category: str | None = None, k: int = 1_000) -> DataFrame:
    """The first stage: postings that pass the filters (see tables.find_jobs), and of them the k nearest by cosine; jobs has (vec_id, embedding) beside the filtered columns."""
    from lodewell.operators.tables import find_jobs

    left = find_jobs(jobs, category=category, years=years)
    if regions:
        left = left.where(F.col("region_code").isin(*regions))
    return top_k_cosine(left, vector, k)


def weighted(features: DataFrame, weights: dict[str, float], key: str) -> DataFrame:
    """(key, score, reasons): the weighted sum of features (null counts 0), and each feature's part of it, the largest first."""
    parts = [F.struct((F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * F.lit(float(w))).alias("part"), F.lit(n).alias("feature")) for n, w in weights.items()]
    scored = features.withColumn("__parts", F.array(*parts))
    total = F.aggregate("__parts", F.lit(0.0), lambda s, p: s + p["part"])
    reasons = F.reverse(F.array_sort("__parts"))
    return scored.select(key, F.round(total, 6).alias("score"), F.transform(reasons, lambda p: F.struct(p["feature"].alias("feature"), F.round(p["part"], 6).alias("part"))).alias("reasons"))


def ranking_metrics(scored: DataFrame, group: str, score: str, relevance: str, k: int = 10, tie: str | None = None) -> DataFrame:
    """(group, ndcg, recall, map) at k, ideal gains from the same rows; ties go by `tie`, the smaller first. Groups without a relevant row have nulls.

    map: the mean over a group's relevant rows within k of the share of relevant rows up to each.
    """
    last = [tie] if tie else []
    by = lambda c: F.row_number().over(Window.partitionBy(group).orderBy(F.desc(c), *last))
    r = scored.withColumn("__r", by(score)).withColumn("__i", by(relevance))
    so_far = F.count_if(F.col(relevance) > 0).over(Window.partitionBy(group).orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("__p", F.when((F.col("__r") <= k) & (F.col(relevance) > 0), so_far / F.col("__r")))
    gain = lambda c: F.sum(F.when(F.col(c) <= k, F.col(relevance) / F.log2(F.col(c) + 1)).otherwise(0.0))
    relevant = F.nullif(F.count_if(F.col(relevance) > 0), F.lit(0))
    hits = F.count_if((F.col("__r") <= k) & (F.col(relevance) > 0)) / relevant
    mean = F.coalesce(F.sum("__p"), F.lit(0.0)) / F.least(relevant, F.lit(k))
    return r.groupBy(group).agg(F.round(gain("__r") / F.nullif(gain("__i"), F.lit(0.0)), 4).alias("ndcg"), F.round(hits, 4).alias("recall"), F.round(mean, 4).alias("map"))


#: Ranges of scores that auc() orders at once, at most.
AUC_RANGES = 1_024


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by counts of distinct scores.

    Scores are cut into ranges at their quantiles; the ranges' sums (AUC_RANGES at most) are ordered in one small
    window, the scores of each range in a window of its own, so no task sorts all scores.
    """
    s = F.col(score).cast("double")
    by = scored.groupBy(s.alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n"))
    cuts = F.broadcast(by.agg(F.percentile_approx("s", [i / AUC_RANGES for i in range(1, AUC_RANGES)], 10 * AUC_RANGES).alias("cuts")))
    ranged = by.crossJoin(cuts).withColumn("range", F.coalesce(F.size(F.filter(F.array_distinct("cuts"), lambda x: x < F.col("s"))), F.lit(0))).drop("cuts")  # cuts: one row
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("n"))
    bases = sums.select("range", before(Window.orderBy("range")).alias("base"))
    inside = ranged.withColumn("below", before(Window.partitionBy("range").orderBy("s")))
    w = inside.join(F.broadcast(bases), "range").withColumn("wins", F.col("p") * (F.col("base") + F.col("below") + F.col("n") / 2))
    return w.agg(F.round(F.sum("wins") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)), 6).alias("auc"))
