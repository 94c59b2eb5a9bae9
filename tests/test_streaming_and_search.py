"""Streaming scorer and random-search trials (small budgets)."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL


def _matrix(spark):
    from somnolyt.plans.matrix import fit_model_matrix
    from somnolyt.plans.preprocess import preprocess_cohort
    from somnolyt.sources.cohort import cohort
    return fit_model_matrix(preprocess_cohort(cohort(spark, SF_SMALL), "median"), "binario")


def test_stream_scores_new_patients(spark):
    from somnolyt.operators import models
    from somnolyt.sources.cohort import LITERAL_SCHEMA, literal_patients
    from somnolyt.streaming.scoring import start_scoring
    m, params = _matrix(spark)
    model = models.fit(m, params.features, "RandomForest", params={"numTrees": 10, "maxDepth": 5})
    src_dir = tempfile.mkdtemp(prefix="somnolyt-in-", dir="/tmp")
    out_dir = tempfile.mkdtemp(prefix="somnolyt-out-", dir="/tmp")
    literal_patients(spark).write.mode("overwrite").parquet(src_dir + "/batch1")
    q = start_scoring(spark, src_dir + "/batch1", LITERAL_SCHEMA, params, model, out_dir, name="t_scores")
    q.awaitTermination(120)
    res = spark.read.parquet(out_dir).collect()
    assert len(res) == 1 and 0.0 <= res[0].score <= 1.0


def test_random_search_trials(spark):
    from somnolyt.operators import models
    m, params = _matrix(spark)
    trials = models.random_search(m, params.features, "RandomForest", n_iter=2, k=2, key="patient_id",
                                  space={"numTrees": ("int", 5, 10), "maxDepth": ("int", 2, 4)})
    assert trials.count() == 2
    top = models.top_trials(trials, 5).collect()
    assert top[0].mean_score >= top[-1].mean_score
    assert trials.filter(F.col("mean_score").isNull()).count() == 0
