"""The staged run: ingestion, preprocessing, pairs, evaluation, advanced ranking, explanation, fairness.

    python -m textmill.plans.pipeline --list | --all | --stage NAME   [--data DIR] [--out DIR]

DIR holds jobs.csv, resumes.csv, skills.csv, job_skills.csv and domains.json; stages pass Parquet tables on in --out."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.skills import skill_sets
from ..functions.text import clean_text, normalize_text
from ..functions.vectors import HashingEncoder, encode
from ..operators import fairness, labeling, ltr, metrics, pairs, ranking, tfidf
from ..operators.dictionary import found_terms
from ..operators.explain import explain_batch
from ..sources import readers, sinks


#: Skill names that are sent to the executors; a longer dictionary is joined instead.
MOST_SKILLS = 20_000


def ingestion(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    domains = readers.domain_dictionary(f"{data}/domains.json")
    jobs = labeling.label_domains(readers.csv(spark, f"{data}/jobs.csv", readers.JOBS), domains)
    sinks.table(labeling.balanced_sample(jobs, "assigned_domain", "job_id", config.per_domain, config.seed), f"{out}/jobs")
    rows = readers.csv(spark, f"{data}/resumes.csv", readers.RESUMES)
    sinks.corpus(rows.withColumn("text", clean_text(F.col("text"))), f"{out}/resumes_raw")
    bridge = readers.csv(spark, f"{data}/job_skills.csv", readers.JOB_SKILLS)
    sinks.table(skill_sets(bridge, readers.csv(spark, f"{data}/skills.csv", readers.SKILLS), "job_id"), f"{out}/job_skills")


def preprocessing(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    from ..functions.skills import match_substring

    known = readers.csv(spark, f"{data}/skills.csv", readers.SKILLS).select(F.lower("skill_name").alias("term")).filter("term <> ''").distinct()
    few = known.limit(MOST_SKILLS + 1).collect()
    run = encode(HashingEncoder(), config.encode_batch)
    resumes = spark.read.parquet(f"{out}/resumes_raw").withColumn("text", normalize_text(F.col("text")))
    if len(few) <= MOST_SKILLS:
        resumes = resumes.withColumn("skills", match_substring(F.col("text"), [r["term"] for r in few]))
    else:
        resumes = resumes.join(found_terms(resumes, known, "resume_id").select(F.col("id").alias("resume_id"), F.col("found").alias("skills")), "resume_id")
    sinks.table(resumes.withColumn("vector", run("text")), f"{out}/resumes")
    jobs = spark.read.parquet(f"{out}/jobs").withColumn("text", F.coalesce("description", F.lit(""))).join(spark.read.parquet(f"{out}/job_skills"), "job_id", "left")
    sinks.table(jobs.withColumn("vector", run("text")), f"{out}/jobs_ready")


def make_pairs(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    jobs, resumes = spark.read.parquet(f"{out}/jobs_ready"), spark.read.parquet(f"{out}/resumes")
    made = pairs.domain_pairs(jobs.select("job_id", F.col("assigned_domain").alias("domain")), resumes.select("resume_id", "domain"), config.domain_negatives, config.seed)
    sinks.table(made, f"{out}/pairs_domain")
    texts = jobs.select(F.concat(F.lit("j"), "job_id").alias("id"), "text").unionByName(resumes.select(F.concat(F.lit("r"), "resume_id").alias("id"), "text"))
    vocabulary = tfidf.fitted(texts, max_terms=config.tfidf_terms)
    left = tfidf.transform(jobs.select(F.col("job_id").alias("id"), "text"), vocabulary)
    right = tfidf.transform(resumes.select(F.col("resume_id").alias("id"), "text"), vocabulary)
    scored = pairs.with_zeros(tfidf.similarities(left, right), jobs, resumes, config.semantic_k)
    sinks.table(pairs.extremes(scored, config.semantic_k), f"{out}/pairs_semantic")
    sinks.table(pairs.skill_pairs(jobs.select("job_id", "skills"), resumes.select("resume_id", "skills"), config.skill_k), f"{out}/pairs_skill")


def evaluate(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    jobs, resumes = spark.read.parquet(f"{out}/jobs_ready"), spark.read.parquet(f"{out}/resumes")
    for kind in ("domain", "semantic", "skill"):
        rows = spark.read.parquet(f"{out}/pairs_{kind}").drop("score")
        scored = ranking.score_pairs(rows, jobs, resumes, "drop")
        scored = pairs.coverage_scores(scored, jobs, resumes).withColumn("score", ranking.hybrid_score(F.col("score"), F.col("coverage"), config.hybrid_semantic, config.hybrid_skills))
        frame = scored.select(F.col("job_id").alias("query_id"), F.col("resume_id").alias("doc_id"), F.col("resume_id").alias("pos"), "score", "label")
        for name, result in metrics.evaluate(frame, config.threshold_percentile, config.k_values).items():
            sinks.table(result, f"{out}/metrics/{kind}/{name}")


def advanced(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    jobs, resumes = spark.read.parquet(f"{out}/jobs_ready"), spark.read.parquet(f"{out}/resumes")
    rows = ltr.features(spark.read.parquet(f"{out}/pairs_skill").drop("score"), jobs, resumes)
    model = ltr.Ranker(config.trees, config.tree_depth, config.learning_rate, config.seed)
    done = ltr.train_and_evaluate(rows, model, config.test_share, config.seed)
    sinks.table(done["scored"], f"{out}/ltr")


def explanation(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    jobs, resumes = spark.read.parquet(f"{out}/jobs_ready"), spark.read.parquet(f"{out}/resumes")
    rows = spark.read.parquet(f"{out}/pairs_skill").join(jobs.select("job_id", F.col("skills").alias("job_skills")), "job_id", "left")
    sinks.table(explain_batch(rows, jobs, resumes), f"{out}/explanations")


def fair(spark: SparkSession, data: str, out: str, config: EngineConfig) -> None:
    scores = spark.read.parquet(f"{out}/pairs_semantic").groupBy("resume_id").agg(F.max("score").alias("score"))
    found = fairness.audit(spark.read.parquet(f"{out}/resumes_raw"), scores, impact=config.adverse_impact)
    for name in ("group_distribution", "adverse_impact", "score_distribution", "mann_whitney"):
        sinks.table(found[name], f"{out}/fairness/{name}")


STAGES: dict[str, Callable[[SparkSession, str, str, EngineConfig], None]] = {
    "ingestion": ingestion, "preprocessing": preprocessing, "pairs": make_pairs, "evaluate": evaluate,
    "advanced": advanced, "explain": explanation, "fairness": fair,
}
#: What --all runs.
CORE = ("ingestion", "preprocessing", "pairs", "evaluate")


def run_stage(spark: SparkSession, name: str, data: str, out: str, config: EngineConfig = DEFAULT) -> dict:
    """{stage, seconds, error}: a stage that fails is reported, and the run can go on."""
    stage, began, error = STAGES[name], time.time(), None
    try:
        stage(spark, data, out, config)
    except Exception as e:
        error = f"{type(e).__name__}: {e}"
    return {"stage": name, "seconds": round(time.time() - began, 2), "error": error}


def run_all(spark: SparkSession, data: str, out: str, config: EngineConfig = DEFAULT) -> list[dict]:
    return [run_stage(spark, name, data, out, config) for name in CORE]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textmill")
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("--stage", choices=list(STAGES))
    what.add_argument("--all", action="store_true")
    what.add_argument("--list", action="store_true")
    parser.add_argument("--data", default="data")
    parser.add_argument("--out", default="out")
    given = parser.parse_args(argv)
    if given.list:
        print("\n".join(STAGES))
        return 0
    spark = SparkSession.builder.appName("textmill").getOrCreate()
    results = run_all(spark, given.data, given.out) if given.all else [run_stage(spark, given.stage, given.data, given.out)]
    for r in results:
        print(f"{r['stage']:<14} {r['seconds']:>8.2f} s  {r['error'] or 'done'}")
    return int(any(r["error"] for r in results))


if __name__ == "__main__":
    raise SystemExit(main())
