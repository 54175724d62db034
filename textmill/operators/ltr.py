"""Learning to rank: features of (job, resume) pairs and gradient-boosted trees on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skills import coverage
from ..functions.text import keywords, word_count
from ..functions.vectors import cosine

FEATURES = ["sbert_similarity", "tfidf_similarity", "skill_coverage", "num_matched_skills", "num_jd_skills", "keyword_overlap_ratio", "resume_word_count", "jd_word_count"]


def document_side(docs: DataFrame, key: str) -> DataFrame:
    """What features need of a document, once for each: (key, vector, skills, words, n_words)."""
    return docs.select(key, "vector", F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), keywords(F.col("text")).alias("words"), word_count(F.col("text")).alias("n_words"))


def features(pairs: DataFrame, jobs: DataFrame, resumes: DataFrame, tfidf: DataFrame | None = None) -> DataFrame:
    """pairs plus the eight features. jobs and resumes have (id, text, vector, skills); tfidf (job_id, resume_id, score)
    may lack pairs, which then have 0. Pairs without a job or resume row are dropped."""
    j = document_side(jobs, "job_id").select("job_id", *[F.col(c).alias(f"j_{c}") for c in ("vector", "skills", "words", "n_words")])
    r = document_side(resumes, "resume_id").select("resume_id", *[F.col(c).alias(f"r_{c}") for c in ("vector", "skills", "words", "n_words")])
    # the scores join bare pairs: words and vectors come last, so they travel once
    if tfidf is not None:
        rows = pairs.join(tfidf.select("job_id", "resume_id", F.col("score").alias("__tfidf")), ["job_id", "resume_id"], "left")
    else:
        rows = pairs.withColumn("__tfidf", F.lit(0.0))
    rows = rows.join(j, "job_id").join(r, "resume_id")
    both = F.size(F.array_intersect("j_words", "r_words"))
    return rows.select(
        *pairs.columns,
        cosine(F.col("j_vector"), F.col("r_vector")).alias("sbert_similarity"),
        F.coalesce("__tfidf", F.lit(0.0)).alias("tfidf_similarity"),
        coverage(F.col("r_skills"), F.col("j_skills")).alias("skill_coverage"),
        F.size(F.array_intersect("j_skills", "r_skills")).alias("num_matched_skills"),
        F.size("j_skills").alias("num_jd_skills"),
        F.when(F.size("j_words") > 0, both / F.size("j_words")).otherwise(0.0).alias("keyword_overlap_ratio"),
        F.col("r_n_words").alias("resume_word_count"),
        F.col("j_n_words").alias("jd_word_count"),
    )


class Ranker:
    """Boosted trees on FEATURES (log loss on single pairs); a stand-in of Spark's own for other boosting libraries."""

    def __init__(self, trees: int = 200, depth: int = 6, learning_rate: float = 0.1, seed: int = 42):
        self.trees, self.depth, self.learning_rate, self.seed, self.model = trees, depth, learning_rate, seed, None

    def _assembled(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=FEATURES, outputCol="__x", handleInvalid="keep").transform(rows)

    def fit(self, rows: DataFrame) -> Ranker:
        from pyspark.ml.classification import GBTClassifier

        trees = GBTClassifier(featuresCol="__x", labelCol="__y", maxIter=self.trees, maxDepth=self.depth, stepSize=self.learning_rate, seed=self.seed)
        self.model = trees.fit(self._assembled(rows).withColumn("__y", F.col("label").cast("double")))
        return self

    def _ready(self):
        if self.model is None:
            raise RuntimeError("the ranker has not been fitted")
        return self.model

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows plus score, the probability of label 1."""
        from pyspark.ml.functions import vector_to_array

        out = self._ready().transform(self._assembled(rows))
        return out.select(*rows.columns, vector_to_array("probability")[1].alias("score"))

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(FEATURES, map(float, self._ready().featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def train_and_evaluate(rows: DataFrame, ranker: Ranker | None = None, test_share: float = 0.2, seed: int = 42) -> dict:
    """Split by job, fit on the one part, score and evaluate the other: {ranker, scored, importances, evaluation}."""
    from .metrics import evaluate
    from .pairs import split_queries

    split = split_queries(rows, "job_id", test_share, seed)
    ranker = (ranker or Ranker()).fit(split.filter("is_train = 1"))
    scored = ranker.predict(split.filter("is_train = 0"))
    frame = scored.select(F.col("job_id").alias("query_id"), F.col("resume_id").alias("doc_id"), F.col("resume_id").alias("pos"), "score", "label")
    return {"ranker": ranker, "scored": scored, "importances": ranker.importances(), "evaluation": evaluate(frame)}
