"""Most and least covered sets: for each required set the k sets that hold most of it and the k that hold least, with bounds
on what can be reached, so that a skill that nearly all have doesn't make pairs of all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .metrics import global_ranks

#: Rarest known skills of a job whose lists are probed.
RARE = 4
#: Rows of one size are spread over this many keys of a join, and so many places of ids are one key.
SLICES, STRETCH = 16, 1024


def _sets(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).select(key, F.explode_outer("skills").alias("skill")).groupBy(key).agg(F.collect_set("skill").alias("skills"))


def _block(size: Column) -> Column:
    """Four blocks for each doubling of a size."""
    return F.floor(4 * F.log2(size + 1)).cast("int")


def _slice() -> Column:
    return F.pmod(F.hash("resume_id"), F.lit(SLICES))


def _probes(jobs: DataFrame, resumes: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """Pairs that tell what can be reached: each job with the largest, smallest, first and last resumes (four lists of
    `most`) and with the largest of its rarest skills (RARE lists of `most`)."""
    ends = [resumes.orderBy(*[way(c) for c in cols]).limit(most) for cols in (("size", "resume_id"), ("resume_id",)) for way in (F.asc, F.desc)]
    fixed = reduce(DataFrame.union, ends).dropDuplicates(["resume_id"]).agg(F.collect_list(F.struct("resume_id", "skills")).alias("r"))  # 4 * most rows
    met = jobs.crossJoin(F.broadcast(fixed)).select("job_id", "needed", F.explode("r").alias("r"))  # one row
    met = met.select("job_id", "r.resume_id", F.size(F.array_intersect("needed", "r.skills")).alias("shared"))
    heads = lists.withColumn("rn", F.row_number().over(Window.partitionBy("skill").orderBy(F.desc("size"), F.desc("resume_id")))).filter(F.col("rn") <= most)
    rare = jobs.select("job_id", F.explode(F.expr(f"slice(needed, n - known + 1, {RARE})")).alias("skill"))
    pairs = rare.join(heads, "skill").select("job_id", "resume_id")
    return met.union(_verified(pairs, jobs, resumes)).dropDuplicates(["job_id", "resume_id"])


def _verified(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    both = pairs.distinct().join(jobs.select("job_id", "needed"), "job_id").join(resumes.select("resume_id", "skills"), "resume_id")
    return both.select("job_id", "resume_id", F.size(F.array_intersect("needed", "skills")).alias("shared"))


def _most(limits: DataFrame, lists: DataFrame, largest: int) -> DataFrame:
    """Pairs that can share `floor` skills at least: the resume has so many, and one of the job's n - floor + 1 rarest,
    as no more than floor - 1 are left besides."""
    wanted = limits.withColumn("least", F.greatest("floor", F.lit(1))).filter(F.col("least") <= largest)
    prefix = wanted.select("job_id", "least", F.explode(F.expr("slice(needed, 1, n - least + 1)")).alias("skill"))
    keys = prefix.select("job_id", "least", "skill", F.explode(F.sequence(_block(F.col("least")), _block(F.lit(largest)))).alias("block"))
    return keys.join(lists.withColumn("block", _block(F.col("size"))), ["skill", "block"]).filter("size >= least").select("job_id", "resume_id")


def _fewest(limits: DataFrame, resumes: DataFrame, largest: int, most: int) -> DataFrame:
    """Pairs that can share `ceiling` skills at most, or exactly as many with an id up to `last`. Of a resume's skills no
    more than `missing`, the known ones that the job doesn't ask for, can be outside of the job."""
    rows = resumes.select("resume_id", "size", "place", _slice().alias("slice"), _block(F.col("size")).alias("block"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice")
    edge = (F.col("ceiling") + F.col("missing")).alias("edge")
    under = limits.select("job_id", edge, spread).filter("edge > 0").join(limits.filter("ceiling > 0").select("job_id"), "job_id", "left_semi")
    under = under.select("*", F.explode(F.sequence(F.lit(0), _block(F.least(F.col("edge") - 1, F.lit(largest))))).alias("block"))
    strict = under.join(rows, ["block", "slice"]).filter("size < edge").select("job_id", "resume_id")
    level = limits.filter("ceiling > 0").select("job_id", "last", edge, spread).withColumnRenamed("edge", "size")
    equal = level.join(rows, ["size", "slice"]).filter("last is null or place <= last").select("job_id", "resume_id")
    # none shared: the first ids; the first `most` of all have been probed
    bare = limits.filter((F.col("ceiling") == 0) & (F.col("last") > most))
    bare = bare.select("job_id", "last", "missing", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / STRETCH))).alias("stretch"))
    zero = bare.join(rows.withColumn("stretch", F.floor(F.col("place") / STRETCH)), "stretch").filter("place <= last and size <= missing").select("job_id", "resume_id")
    return strict.union(equal).union(zero)


def covered_ends(job_skills: DataFrame, resume_skills: DataFrame, k: int, probe: int = 8) -> DataFrame:
    """Rows (job_id, resume_id, score, label, compared) of job_skills (job_id, skills) and resume_skills (resume_id,
    skills): for each job the k resumes that have the greatest share of its skills (label 1; ties: the greater id) and
    the k of the least (label 0; ties: the lesser id), and how many resumes were compared with the job.

    Some probes of each job give a floor for the k-th best and a ceiling for the k-th least. Above the floor are only
    resumes that are large enough and have one of the job's rarest skills (a prefix, by pigeonholes); below the ceiling
    only those whose size leaves so few skills to share. Only these pairs are made, and their whole sets compared.
    The result is exact; data decide how much is left out. A job whose skills are common, but far from all, may meet
    many. Lists are joined by skill and size, sizes by slices of ids, so no key holds what a common skill holds.

    Defined results: rows of one id are united; null ids and null skills are left out; jobs without skills give no rows,
    resumes without skills have the share 0; fewer than 2k resumes get both labels, fewer than k all do."""
    most = probe * k
    sets = _sets(resume_skills, "resume_id").withColumns({"size": F.size("skills"), "label": F.lit(0)})
    places = global_ranks(sets.select("resume_id", "label"), F.asc("resume_id")).select("resume_id", F.col("rn").alias("place"))
    resumes = written(sets.drop("label").join(places, "resume_id"), "resumes")
    largest = resumes.agg(F.max("size")).first()[0] or 0
    lists = resumes.select("resume_id", "size", F.explode("skills").alias("skill"))
    known = written(lists.groupBy("skill").agg(F.count("*").alias("df")), "skills")
    asked = _sets(job_skills, "job_id").select("job_id", F.explode("skills").alias("skill")).join(known, "skill", "left")
    rarest = F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "skill"))), lambda x: x["skill"])
    jobs = asked.groupBy("job_id").agg(rarest.alias("needed"), F.count("*").cast("int").alias("n"), F.count("df").cast("int").alias("known"))
    jobs = written(jobs.withColumn("missing", F.lit(known.count()) - F.col("known")), "jobs")
    probes = written(_probes(jobs, resumes, lists, most), "probes")
    by = Window.partitionBy("job_id")
    best = probes.withColumn("rn", F.row_number().over(by.orderBy(F.desc("shared"), F.desc("resume_id")))).filter(F.col("rn") == k).select("job_id", F.col("shared").alias("floor"))
    least = probes.withColumn("rn", F.row_number().over(by.orderBy("shared", "resume_id"))).filter(F.col("rn") == k)
    least = least.join(resumes.select("resume_id", "place"), "resume_id").select("job_id", F.col("shared").alias("ceiling"), F.col("place").alias("last"))
    limits = jobs.join(best, "job_id", "left").join(least, "job_id", "left")
    limits = written(limits.withColumns({"floor": F.coalesce("floor", F.lit(0)), "ceiling": F.coalesce("ceiling", "n")}), "limits")
    pairs = _most(limits, lists, largest).union(_fewest(limits, resumes, largest, most)).distinct()
    later = _verified(pairs.join(probes, ["job_id", "resume_id"], "left_anti"), jobs, resumes)
    every = written(probes.unionByName(later), "shared")
    counts = every.groupBy("job_id").agg(F.count("*").alias("compared"))
    scored = every.join(jobs.select("job_id", "n"), "job_id").select("job_id", "resume_id", (F.col("shared") / F.col("n")).alias("score"))
    from .pairs import extremes

    return extremes(scored, k).join(counts, "job_id")
