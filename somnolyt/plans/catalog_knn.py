"""kNN join, kNN imputation and class-balancing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import impute, knn, models, recode, search
from ..session import scratch_path
from ..sources import cohort as src
from . import oracle_sql as O
from .catalog import _PRE_DOUBLES, _RECODED_COLS, _preprocessed, _recoded
from .oracle_knn import add_knn_impute
from .registry import query


def _knn_impute_sql():
    ch = O.cohort_chain().add("recoded", O.RECODED).add("dense", O.dense_sql())
    last = add_knn_impute(ch, "dense")
    return ch.sql(O.rounded_select(_RECODED_COLS, set(O.NUMERIC), last))


@query("knn_impute", _knn_impute_sql())
def q_knn_impute(spark, sf_dir):
    """Distance-weighted 7-NN imputation of all numeric cohort columns."""
    df = recode.drop_sparse_rows(_recoded(spark, sf_dir))
    return impute.impute(df, "knn")


def _pre_knn_sql():
    ch, last = O.preprocessed_chain("knn")
    return ch.sql(O.rounded_select(O.PREPROCESSED_COLUMNS, _PRE_DOUBLES, last))


@query("preprocess_cohort_knn", _pre_knn_sql())
def q_pre_knn(spark, sf_dir):
    """E13 with the reference default (kNN imputation)."""
    return _preprocessed(spark, sf_dir, "knn").select(*O.PREPROCESSED_COLUMNS)


# ---------------------------------------------------------------- embeddings: kNN join and balancing

from ..operators import balance  # noqa: E402

_D2 = "list_sum(list_transform(list_zip(a.vector, b.vector), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _u(tag, *cols):
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', '42', {parts}, '{tag}')), 1, 8)) AS UBIGINT)"
            f" / CAST(4294967296 AS DOUBLE))")


def _emb_sql(label_expr):
    return (f"emb AS (SELECT vec_id AS row_id, CAST({label_expr} AS INTEGER) AS label, "
            f"CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)")


def embeddings_binary(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") < 2).cast("int").alias("label"),
                    F.col("embedding").cast("array<double>").alias("vector"))


def embeddings_four(spark, sf_dir):
    e = src.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), F.floor(F.col("label") / 3).cast("int").alias("label"),
                    F.col("embedding").cast("array<double>").alias("vector"))


def _tall(df):
    return df.select("row_id", "label", "is_synthetic",
                     F.posexplode("vector").alias("pos", "value"))


_TALL_SQL = """SELECT row_id, label, is_synthetic, CAST(unnest(range(len(vector))) AS INTEGER) AS pos,
  round(unnest(vector), 6) AS value FROM {src}"""


@query("knn_join", f"""WITH {_emb_sql('label < 2')}
SELECT row_id, nbr, CAST(rank AS INTEGER) AS rank, round(d2, 6) AS d2 FROM (
  SELECT a.row_id, b.row_id AS nbr, {_D2} AS d2,
         row_number() OVER (PARTITION BY a.row_id ORDER BY {_D2}, b.row_id) AS rank
  FROM emb a JOIN emb b ON a.row_id <> b.row_id) WHERE rank <= 5""")
def q_knn_join(spark, sf_dir):
    """M1: exact 5 nearest neighbours of every embedding (self excluded)."""
    e = embeddings_binary(spark, sf_dir)
    return knn.knn_join(e, e, "vector", 5, qkey="row_id", exclude_self=True).select(
        "row_id", "nbr", "rank", "d2")


def _smote_ctes(src_name="emb"):
    return f"""cnt AS (SELECT label, count(*) AS n FROM {src_name} GROUP BY label),
grow AS (SELECT label, n, (SELECT max(n) FROM cnt) - n AS g, least(5, n - 1) AS kk FROM cnt
         WHERE n < (SELECT max(n) FROM cnt)),
goff AS (SELECT label, coalesce(sum(g) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM grow),
mino AS (SELECT e.*, row_number() OVER (PARTITION BY e.label ORDER BY e.row_id) AS rn FROM {src_name} e
         WHERE e.label IN (SELECT label FROM grow)),
mnn AS (SELECT a.label, a.row_id, b.row_id AS nbr,
        row_number() OVER (PARTITION BY a.row_id ORDER BY {_D2}, b.row_id) AS rank
        FROM mino a JOIN mino b ON a.label = b.label AND a.row_id <> b.row_id),
draws AS (SELECT label, unnest(range(g)) AS draw FROM grow),
du AS (SELECT d.label, d.draw, floor({_u('base', 'd.label', 'd.draw')} * n) + 1 AS rn,
       floor({_u('nbr', 'd.label', 'd.draw')} * kk) + 1 AS rank, {_u('gap', 'd.label', 'd.draw')} AS gap
       FROM draws d JOIN grow USING (label)),
syn AS (SELECT (SELECT max(row_id) FROM {src_name}) + 1 + o.off + du.draw AS row_id, du.label,
        list_transform(list_zip(b.vector, nb.vector), lambda x: x[1] + du.gap * (x[2] - x[1])) AS vector
        FROM du JOIN goff o ON o.label = du.label JOIN mino b ON b.label = du.label AND b.rn = du.rn
        JOIN mnn m ON m.row_id = b.row_id AND m.rank = du.rank JOIN {src_name} nb ON nb.row_id = m.nbr),
sm AS (SELECT row_id, label, false AS is_synthetic, vector FROM {src_name}
       UNION ALL SELECT CAST(row_id AS BIGINT), label, true, vector FROM syn)"""


@query("smote", f"WITH {_emb_sql('label < 2')},\n{_smote_ctes()}\n" + _TALL_SQL.format(src="sm"))
def q_smote(spark, sf_dir):
    """SMOTE to the majority size (binary embeddings), rows in long form."""
    return _tall(balance.smote(embeddings_binary(spark, sf_dir)))


@query("sink_resampled", f"WITH {_emb_sql('label < 2')},\n{_smote_ctes()}\n" + _TALL_SQL.format(src="sm"))
def q_sink_resampled(spark, sf_dir):
    """Resampled rows written as Parquet partitioned by is_synthetic and read back."""
    path = scratch_path(spark, f"sink/resampled-{uuid.uuid4().hex}")
    balance.smote(embeddings_binary(spark, sf_dir)).write.partitionBy("is_synthetic").parquet(path)
    back = spark.read.parquet(path)
    return _tall(back.withColumn("is_synthetic", F.col("is_synthetic").cast("boolean")))


_TOMEK = """dist AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, {d2} AS d2
        FROM {src} a JOIN {src} b ON a.row_id <> b.row_id),
near AS MATERIALIZED (SELECT a, min(struct_pack(d2 := d2, b := b)).b AS b FROM dist GROUP BY a),
links AS (SELECT x.a, x.b, la.label AS la, lb.label AS lb FROM near x JOIN near y ON x.a = y.b AND x.b = y.a
          JOIN {src} la ON la.row_id = x.a JOIN {src} lb ON lb.row_id = x.b WHERE la.label <> lb.label)"""


@query("tomek_links", f"WITH {_emb_sql('label < 2')},\n{_TOMEK.format(d2=_D2, src='emb')}\n"
       "SELECT a, b, la, lb FROM links")
def q_tomek(spark, sf_dir):
    """I4: mutual nearest neighbours with different labels."""
    return balance.tomek_links(embeddings_binary(spark, sf_dir))


@query("tomek_removed", f"WITH {_emb_sql('label < 2')},\n{_TOMEK.format(d2=_D2, src='emb')}\n"
       "SELECT row_id, label FROM emb WHERE row_id NOT IN (SELECT a FROM links)")
def q_tomek_removed(spark, sf_dir):
    """Rows left when both members of every Tomek link are removed (the
    embeddings have links before SMOTE and none after it)."""
    return balance.remove_tomek(embeddings_binary(spark, sf_dir)).select("row_id", "label")


@query("smote_tomek", f"WITH {_emb_sql('label < 2')},\n{_smote_ctes()},\n{_TOMEK.format(d2=_D2, src='sm')},\n"
       "kept AS (SELECT * FROM sm WHERE row_id NOT IN (SELECT a FROM links))\n" + _TALL_SQL.format(src="kept"))
def q_smote_tomek(spark, sf_dir):
    """SMOTE then removal of both members of every Tomek link."""
    return _tall(balance.smote_tomek(embeddings_binary(spark, sf_dir)))


def embeddings_plane(spark, sf_dir):
    """The first two components, where the classes overlap."""
    return embeddings_binary(spark, sf_dir).withColumn("vector", F.slice("vector", 1, 2))


@query("smote_tomek_plane", f"WITH {_emb_sql('label < 2').replace('AS DOUBLE[])', 'AS DOUBLE[])[1:2]')},\n{_smote_ctes()},\n"
       f"{_TOMEK.format(d2=_D2, src='sm')},\nkept AS (SELECT * FROM sm WHERE row_id NOT IN (SELECT a FROM links))\n"
       + _TALL_SQL.format(src="kept"))
def q_smote_tomek_plane(spark, sf_dir):
    """I5 on rows that still have links after SMOTE."""
    return _tall(balance.smote_tomek(embeddings_plane(spark, sf_dir)))


def _adasyn_sql():
    return f"""WITH {_emb_sql('floor(label / 3)')},
cnt AS (SELECT label, count(*) AS n FROM emb GROUP BY label),
grow AS (SELECT label, n, (SELECT max(n) FROM cnt) - n AS g, least(5, n - 1) AS kk FROM cnt
         WHERE n < (SELECT max(n) FROM cnt)),
mino AS (SELECT e.* FROM emb e WHERE e.label IN (SELECT label FROM grow)),
nnall AS (SELECT * FROM (SELECT a.row_id, a.label, b.label AS nlabel,
          row_number() OVER (PARTITION BY a.row_id ORDER BY {_D2}, b.row_id) AS rank
          FROM mino a JOIN emb b ON a.row_id <> b.row_id) WHERE rank <= 5),
rr AS (SELECT row_id, label, count(*) FILTER (WHERE nlabel <> label) / CAST(5 AS DOUBLE) AS r FROM nnall GROUP BY row_id, label),
gg AS (SELECT row_id, label, CAST(round_even(r / sum(r) OVER (PARTITION BY label) * g, 0) AS BIGINT) AS gi
       FROM rr JOIN grow USING (label)),
offs AS (SELECT label, row_id, coalesce(sum(gi) OVER (ORDER BY label, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM gg WHERE gi > 0),
mnn AS (SELECT a.label, a.row_id, b.row_id AS nbr,
        row_number() OVER (PARTITION BY a.row_id ORDER BY {_D2}, b.row_id) AS rank
        FROM mino a JOIN mino b ON a.label = b.label AND a.row_id <> b.row_id),
draws AS (SELECT row_id, label, unnest(range(gi)) AS draw FROM gg WHERE gi > 0),
du AS (SELECT d.row_id, d.label, d.draw, floor({_u('nbr', 'd.label', 'd.row_id', 'd.draw')} * kk) + 1 AS rank,
       {_u('gap', 'd.label', 'd.row_id', 'd.draw')} AS gap FROM draws d JOIN grow USING (label)),
syn AS (SELECT (SELECT max(row_id) FROM emb) + 1 + o.off + du.draw AS row_id, du.label,
        list_transform(list_zip(b.vector, nb.vector), lambda x: x[1] + du.gap * (x[2] - x[1])) AS vector
        FROM du JOIN offs o ON o.row_id = du.row_id JOIN emb b ON b.row_id = du.row_id
        JOIN mnn m ON m.row_id = du.row_id AND m.rank = du.rank JOIN emb nb ON nb.row_id = m.nbr),
sm AS (SELECT row_id, label, false AS is_synthetic, vector FROM emb
       UNION ALL SELECT CAST(row_id AS BIGINT), label, true, vector FROM syn)
""" + _TALL_SQL.format(src="sm")


@query("adasyn", _adasyn_sql())
def q_adasyn(spark, sf_dir):
    """ADASYN on four classes (embedding label div 3)."""
    return _tall(balance.adasyn(embeddings_four(spark, sf_dir)))


@query("embedding_imbalance", f"""WITH {_emb_sql('label < 2')}
SELECT CAST(max(n) AS BIGINT) AS n_max, CAST(min(n) AS BIGINT) AS n_min, round(max(n) / CAST(min(n) AS DOUBLE), 6) AS ratio,
  max(n) / CAST(min(n) AS DOUBLE) > 1.5 AS needs_balancing FROM (SELECT label, count(*) AS n FROM emb GROUP BY label)""")
def q_emb_imbalance(spark, sf_dir):
    """The 1.5 gate on the binary embedding labels."""
    return balance.class_counts_ratio(embeddings_binary(spark, sf_dir))


_SEARCH_SQL = f"""WITH {_emb_sql('label < 2')},
drawn AS (SELECT *, {_u('fold', 'row_id')} AS u FROM emb),
folded AS (SELECT row_id, label, vector,
  (row_number() OVER (PARTITION BY label ORDER BY u, row_id) - 1) % 5 AS fold FROM drawn),
trials AS (SELECT unnest(range(50)) AS trial),
weights AS (SELECT trial, pos, 2 * {_u('weight', 'trial', 'pos')} - 1 AS w
            FROM trials, (SELECT unnest(range((SELECT max(len(vector)) FROM emb))) AS pos)),
entry AS (SELECT row_id, label, fold, unnest(range(len(vector))) AS pos, unnest(vector) AS x FROM folded),
z AS MATERIALIZED (SELECT trial, row_id, label, fold, sum(w * x) AS z FROM entry JOIN weights USING (pos) GROUP BY ALL),
models AS (SELECT unnest(range(5)) AS f),
means AS (SELECT trial, f, avg(z) FILTER (WHERE label = 0) AS m0, avg(z) FILTER (WHERE label = 1) AS m1
          FROM z, models WHERE fold <> f GROUP BY trial, f),
said AS (SELECT m.trial, f, label, fold = f AS held, CAST(
           CASE WHEN m1 >= m0 THEN z >= m0 + {_u('share', 'm.trial')} * (m1 - m0)
                ELSE z <= m0 + {_u('share', 'm.trial')} * (m1 - m0) END AS INTEGER) AS prediction
         FROM means m JOIN z ON z.trial = m.trial),
recall AS (SELECT trial, f, held, label, avg(CAST(label = prediction AS INTEGER)) AS r FROM said GROUP BY ALL),
score AS (SELECT trial, f, held, avg(r) AS s FROM recall GROUP BY ALL),
found AS (SELECT trial, avg(s) FILTER (WHERE held) AS mean_score, stddev_pop(s) FILTER (WHERE held) AS std_score,
                 avg(s) FILTER (WHERE NOT held) AS mean_train_score FROM score GROUP BY trial)
SELECT CAST(row_number() OVER (ORDER BY round(mean_score, 9) DESC, trial) AS INTEGER) AS rank, CAST(trial AS INTEGER) AS trial,
  round({_u('share', 'trial')}, 6) AS share, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score,
  round(mean_train_score, 6) AS mean_train_score
FROM found QUALIFY rank <= 5"""


@query("search_top_trials", _SEARCH_SQL)
def q_search(spark, sf_dir):
    """Five best of 50 drawn linear rules over 5 folds, with train scores."""
    trials = search.linear_search(embeddings_binary(spark, sf_dir))
    best = models.top_trials(trials, 5)
    share = F.get_json_object("params", "$.share").cast("double").alias("share")
    return best.select("rank", "trial", share, "mean_score", "std_score", "mean_train_score")
