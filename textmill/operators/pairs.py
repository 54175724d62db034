"""Labelled (job, resume) pairs by domain, by text similarity and by skills; splits by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skills import coverage
from .containment import covered_ends
from .labeling import seeded


def _numbered(resumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (resume_id, resume_domain, slot), slots from 1 in each domain by id, and rows (resume_domain, size). Places come
    from counts over sorted ranges: no task holds a domain."""
    from .metrics import global_ranks

    rows = resumes.select("resume_id", F.col("domain").alias("resume_domain"), F.lit(0).alias("label")).filter(F.col("resume_domain").isNotNull())
    placed = global_ranks(rows, F.col("resume_domain"), F.col("resume_id"))
    sized = placed.groupBy("resume_domain").agg(F.count("*").alias("size"), F.min("rn").alias("first"))
    slots = placed.join(sized.select("resume_domain", "first"), "resume_domain")
    return slots.select("resume_id", "resume_domain", (F.col("rn") - F.col("first") + 1).alias("slot")), sized.select("resume_domain", "size")


def _drawn(asked: DataFrame, numbered: DataFrame, n: int, seed: int) -> DataFrame:
    """n slots for each row of asked (job_id, jd_domain, resume_domain, size): those from a digest of job and domain on."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("job_id").cast("string"), F.col("resume_domain").cast("string")))
    start = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.col("size"))
    rows = asked.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("size")).cast("int") - 1)).alias("i"))
    rows = rows.withColumn("slot", F.pmod(start + F.col("i"), F.col("size")) + 1)
    return rows.join(numbered, ["resume_domain", "slot"]).select("job_id", "jd_domain", "resume_id", "resume_domain")


def domain_positives(jobs: DataFrame, resumes: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """Rows (job_id, resume_id, label 1, jd_domain, resume_domain): n resumes of the job's own domain, from a seeded place on.

    What is joined is jobs by n, not all pairs of a domain."""
    numbered, sized = _numbered(resumes)
    own = jobs.select("job_id", F.col("domain").alias("jd_domain")).join(sized, F.col("jd_domain") == F.col("resume_domain"))
    return _drawn(own, numbered, n, seed).withColumn("label", F.lit(1))


def domain_negatives(jobs: DataFrame, resumes: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """Rows as above with label 0: n resumes of other domains for each job that has a resume of its own.

    No join of all pairs: a job takes n candidates from each other domain, from a seeded place on, and the first n of these
    in seeded order; what is joined is jobs by domains by n."""
    numbered, sized = _numbered(resumes)
    own = jobs.select("job_id", F.col("domain").alias("jd_domain"))
    here = own.join(sized, F.col("jd_domain") == F.col("resume_domain"), "left_semi")
    asked = here.join(sized, F.col("jd_domain") != F.col("resume_domain"))
    return _pick(_drawn(asked, numbered, n, seed), n, seed).withColumn("label", F.lit(0))


def _pick(pairs: DataFrame, n: int, seed: int) -> DataFrame:
    by = Window.partitionBy("job_id").orderBy("__order", "resume_id")
    return pairs.withColumn("__order", seeded(seed, "job_id", "resume_id")).withColumn("__rn", F.row_number().over(by)).filter(F.col("__rn") <= n).drop("__order", "__rn")


def domain_pairs(jobs: DataFrame, resumes: DataFrame, negatives: int = 3, seed: int = 42) -> DataFrame:
    return domain_positives(jobs, resumes, 1, seed).unionByName(domain_negatives(jobs, resumes, negatives, seed))


def extremes(scored: DataFrame, k: int, job: str = "job_id", resume: str = "resume_id") -> DataFrame:
    """Rows (job, resume, score, label): the k best as 1 and the k worst as 0, by (score, resume).

    With fewer than 2k candidates some have both labels. Each cut is taken before the shuffle, too."""
    best = Window.partitionBy(job).orderBy(F.desc("score"), F.desc(resume))
    worst = Window.partitionBy(job).orderBy(F.asc("score"), F.asc(resume))
    cols = [job, resume, "score"]
    top = scored.select(*cols, F.row_number().over(best).alias("rn")).filter(F.col("rn") <= k).select(*cols, F.lit(1).alias("label"))
    low = scored.select(*cols, F.row_number().over(worst).alias("rn")).filter(F.col("rn") <= k).select(*cols, F.lit(0).alias("label"))
    return top.unionByName(low)


def skill_pairs(job_skills: DataFrame, resume_skills: DataFrame, k: int = 5) -> DataFrame:
    """extremes() by coverage of the job's skills, found by bounds: only pairs that can be among the k are made."""
    return covered_ends(job_skills, resume_skills, k).drop("compared")


def with_zeros(scored: DataFrame, jobs: DataFrame, resumes: DataFrame, k: int) -> DataFrame:
    """scored plus as many pairs of score 0 as extremes(k) can need: for each job the first k and the last k absent ids.

    Ids get places in their whole order from counts over sorted ranges. Present ids are counted by job and stretch of
    places; only stretches up to the k-th absent id, from either end, are spelled out."""
    from .metrics import global_ranks

    ids = resumes.select("resume_id").distinct()
    n = ids.count()
    placed = global_ranks(ids.withColumn("label", F.lit(0)), F.asc("resume_id")).select("resume_id", "rn")
    present = scored.select("job_id", "resume_id").join(placed, "resume_id")
    asked = jobs.select("job_id").distinct()
    low = _first_absent(present.select("job_id", "rn"), asked, n, k)
    high = _first_absent(present.select("job_id", (n + 1 - F.col("rn")).alias("rn")), asked, n, k).select("job_id", (n + 1 - F.col("rn")).alias("rn"))
    zero = low.union(high).distinct().join(placed, "rn").select("job_id", "resume_id").join(scored, ["job_id", "resume_id"], "left_anti")
    return scored.unionByName(zero.withColumn("score", F.lit(0.0)), allowMissingColumns=True)


def _first_absent(present: DataFrame, jobs: DataFrame, n: int, k: int) -> DataFrame:
    """Places (job_id, rn) among which are each job's first k of 1..n that are not present."""
    size = max(128, k)
    counts = present.groupBy("job_id", F.floor((F.col("rn") - 1) / size).alias("stretch")).agg(F.count("*").alias("c"))
    by = Window.partitionBy("job_id").orderBy("stretch")
    before = F.col("stretch") * size - F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a stretch without a present id has enough: none after it is needed
    full = counts.withColumns({"i": F.row_number().over(by) - 1, "absent": before}).filter((F.col("stretch") == F.col("i")) & (F.col("absent") < k))
    after = jobs.join(full.groupBy("job_id").agg((F.max("stretch") + 1).alias("stretch")), "job_id", "left").select("job_id", F.coalesce("stretch", F.lit(0)).alias("stretch"))
    needed = full.filter(F.col("c") < size).select("job_id", "stretch").union(after).filter(F.col("stretch") * size < n)
    return needed.select("job_id", F.explode(F.sequence(F.col("stretch") * size + 1, F.least((F.col("stretch") + 1) * size, F.lit(n)))).alias("rn"))


def coverage_scores(pairs: DataFrame, job_skills: DataFrame, resume_skills: DataFrame) -> DataFrame:
    """pairs plus coverage; jobs and resumes without a row have no skills."""
    j = job_skills.select("job_id", F.col("skills").alias("required"))
    r = resume_skills.select("resume_id", F.col("skills").alias("have"))
    return pairs.join(j, "job_id", "left").join(r, "resume_id", "left").withColumn("coverage", coverage(F.col("have"), F.col("required"))).drop("required", "have")


def split_queries(rows: DataFrame, query: str = "query_id", test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """rows plus is_train: the first floor(n * (1 - test_share)) of the distinct queries in seeded order, at least one.

    Only the distinct ids are ranked, over sorted ranges."""
    from .metrics import global_ranks

    ids = rows.select(query).filter(F.col(query).isNotNull()).distinct().withColumns({"label": F.lit(0), "order": seeded(seed, query)})
    placed = global_ranks(ids, F.col("order"), F.col(query))
    total = ids.agg(F.count("*").alias("total"))
    flags = placed.crossJoin(F.broadcast(total)).select(query, (F.col("rn") <= F.floor(F.col("total") * (1 - test_share))).cast("int").alias("is_train"))
    return rows.join(flags, query)
