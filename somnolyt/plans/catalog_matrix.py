"""Encoding, scaling, model-matrix, target and split queries with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, recode, split
from ..sources import cohort as src
from . import oracle_sql as O
from .catalog import _preprocessed
from .matrix import EXCLUDED, fit_model_matrix, to_tall
from .registry import query


def _u_sql(key: str, tag: str, seed: int = 42) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR), '{tag}')), 1, 8)) AS UBIGINT)"
            f" / CAST(4294967296 AS DOUBLE)")


def _top8_sql(table, c):
    return f"""SELECT value FROM (SELECT CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS rk
  FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rk <= 8"""


def _rare_case(table, c):
    return (f"CASE WHEN (SELECT count(DISTINCT {c}) FROM {table}) > 10 THEN "
            f"(CASE WHEN CAST({c} AS VARCHAR) IN ({_top8_sql(table, c)}) THEN CAST({c} AS VARCHAR) ELSE 'Otros' END) "
            f"ELSE CAST({c} AS VARCHAR) END")


@query("group_rare_categories", f"""SELECT p_partkey, {_rare_case('part', 'p_brand')} AS p_brand,
  {_rare_case('part', 'p_type')} AS p_type FROM part""")
def q_rare(spark, sf_dir):
    """H1: more than 10 levels -> keep the top 8, the rest (and missing) -> 'Otros'."""
    part = src.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    kept = encode.fit_rare_categories(part, ["p_brand", "p_type"])
    return encode.apply_rare_categories(part, kept)


@query("one_hot", f"""WITH g AS (SELECT p_partkey, {_rare_case('part', 'p_brand')} AS p_brand FROM part),
lv AS (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM (SELECT DISTINCT p_brand AS value FROM g WHERE p_brand IS NOT NULL))
SELECT p_partkey, 'p_brand_' || value AS feature, CAST(CASE WHEN p_brand = value THEN 1 ELSE 0 END AS DOUBLE) AS value
FROM g CROSS JOIN lv WHERE rn > 1""")
def q_one_hot(spark, sf_dir):
    """H2: one-hot by fitted, sorted levels (first dropped), in long form."""
    part = src.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    part = encode.apply_rare_categories(part, encode.fit_rare_categories(part, ["p_brand"]))
    levels = encode.fit_levels(part, ["p_brand"])
    wide = encode.one_hot(part, levels)
    feats = [c for c in wide.columns if c != "p_partkey"]
    return to_tall(wide, feats, key="p_partkey")


SUPP = ["s_acctbal", "s_nationkey"]


def _robust_sql():
    cols = []
    for c in SUPP:
        cols.append(f"""round((CAST({c} AS DOUBLE) - (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM supplier))
  / (SELECT CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
     quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM supplier)), 6) AS {c}""")
    return f"SELECT s_suppkey, {', '.join(cols)} FROM supplier"


@query("robust_scale", _robust_sql())
def q_robust(spark, sf_dir):
    """H3: (x - median) / IQR with exact quartiles; zero IQR divides by 1."""
    sup = src.table(spark, sf_dir, "supplier").select("s_suppkey", *SUPP)
    return encode.fit_robust(sup, SUPP).apply(sup)


def _split_sql(table, key, label_expr, tag="split", extra=""):
    return f"""SELECT *, CASE WHEN rk <= floor(CAST(0.2 AS DOUBLE) * n + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, {key}) AS rk, count(*) OVER (PARTITION BY label) AS n
  FROM (SELECT *, {label_expr} AS label, {_u_sql(key, tag)} AS u FROM {table}{extra}))"""


def _standard_sql():
    sp = _split_sql("supplier", "s_suppkey", "CAST(s_acctbal > 0 AS INTEGER)")
    cols = ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM sp WHERE split = 'train')) / "
        f"(SELECT CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1 ELSE stddev_pop(CAST({c} AS DOUBLE)) END "
        f"FROM sp WHERE split = 'train'), 6) AS {c}" for c in SUPP)
    return f"WITH sp AS ({sp})\nSELECT s_suppkey, split, {cols} FROM sp"


@query("standard_scale", _standard_sql())
def q_standard(spark, sf_dir):
    """H4: mean / population std fitted on the train split, applied to all rows."""
    sup = src.table(spark, sf_dir, "supplier").select("s_suppkey", *SUPP)
    sup = sup.withColumn("label", (F.col("s_acctbal") > 0).cast("int"))
    sp = split.stratified_split(sup, "label", "s_suppkey")
    sc = encode.fit_standard(sp.filter(F.col("split") == "train"), SUPP)
    return sc.apply(sp).select("s_suppkey", "split", *SUPP)


PRE_FEATURES = [c for c in O.PREPROCESSED_COLUMNS
                if c not in EXCLUDED and c not in ("patient_id", "bmi_categoria", "categoria_pa")]
BMI_DUMMIES = ["Normal", "Sobrepeso", "Obesidad I", "Obesidad II", "Obesidad III"]


def _matrix_sql(mode_label="apnea"):
    ch, last = O.preprocessed_chain("median")
    ch.add("lvpa", f"""SELECT value, row_number() OVER (ORDER BY value) AS rn FROM
  (SELECT DISTINCT categoria_pa AS value FROM {last} WHERE categoria_pa IS NOT NULL)""")
    parts = [f"SELECT patient_id, {mode_label} AS label, '{c}' AS feature, CAST({c} AS DOUBLE) AS raw FROM {last}"
             for c in PRE_FEATURES]
    parts += [f"""SELECT patient_id, {mode_label} AS label, 'bmi_categoria_{v}' AS feature,
  CAST(CASE WHEN bmi_categoria = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS raw FROM {last}""" for v in BMI_DUMMIES]
    parts.append(f"""SELECT patient_id, {mode_label} AS label, 'categoria_pa_' || value AS feature,
  CAST(CASE WHEN categoria_pa = value THEN 1 ELSE 0 END AS DOUBLE) AS raw FROM {last} CROSS JOIN lvpa WHERE rn > 1""")
    ch.add("tall", "\nUNION ALL\n".join(parts))
    ch.add("sc", """SELECT feature, quantile_cont(raw, 0.25) AS q1, quantile_cont(raw, 0.5) AS med,
  quantile_cont(raw, 0.75) AS q3 FROM tall GROUP BY feature""")
    return ch


@query("model_matrix", _matrix_sql().sql("""SELECT patient_id, CAST(label AS INTEGER) AS label, feature,
  round((raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END, 6) AS value FROM tall JOIN sc USING (feature)"""))
def q_matrix(spark, sf_dir):
    """H8: model matrix (binary mode) in long form: robust-scaled features."""
    m, params = fit_model_matrix(_preprocessed(spark, sf_dir), "binario")
    return to_tall(m, params.features, keep=["label"])


def _target_sql():
    ch, last = O.preprocessed_chain("median")
    return ch.sql(f"""SELECT 'binario' AS mode, patient_id, CAST(apnea AS INTEGER) AS label FROM {last}
UNION ALL SELECT 'multiclase' AS mode, patient_id, CAST(apnea_severity_ordinal AS INTEGER) AS label FROM {last}""")


@query("select_target", _target_sql())
def q_target(spark, sf_dir):
    """Label per mode."""
    from .matrix import select_target
    df = _preprocessed(spark, sf_dir)
    out = None
    for mode in ("binario", "multiclase"):
        t = df.select(F.lit(mode).alias("mode"), "patient_id",
                      F.col(select_target(df, mode)).cast("int").alias("label"))
        out = t if out is None else out.unionByName(t)
    return out


def _weights_sql():
    ch, last = O.preprocessed_chain("median")
    parts = []
    for mode, col in [("binario", "apnea"), ("multiclase", "apnea_severity_ordinal")]:
        parts.append(f"""SELECT '{mode}' AS mode, CAST({col} AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM {last} GROUP BY {col}""")
    return ch.sql("\nUNION ALL\n".join(parts))


@query("class_weights", _weights_sql())
def q_weights(spark, sf_dir):
    """K7: balanced class weights n / (k * n_class) per mode."""
    df = _preprocessed(spark, sf_dir)
    out = None
    for mode, col in [("binario", "apnea"), ("multiclase", "apnea_severity_ordinal")]:
        w = encode.class_weights(df.select(F.col(col).cast("int").alias("label")), "label")
        w = w.select(F.lit(mode).alias("mode"), "label", "n", "weight")
        out = w if out is None else out.unionByName(w)
    return out


EV = ["event_id", "event_type", "user_id", "value", "props"]


@query("coerce_numeric", "SELECT " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in EV) + " FROM events")
def q_coerce(spark, sf_dir):
    """To number, bad text -> NULL."""
    ev = src.table(spark, sf_dir, "events").select(*EV)
    return recode.coerce_numeric(ev, EV, key="__none__")


@query("fill_and_finite", "SELECT " + ", ".join(
    f"CASE WHEN TRY_CAST({c} AS DOUBLE) IS NULL OR isnan(TRY_CAST({c} AS DOUBLE)) OR isinf(TRY_CAST({c} AS DOUBLE)) "
    f"THEN CAST(0 AS DOUBLE) ELSE TRY_CAST({c} AS DOUBLE) END AS {c}" for c in EV) + " FROM events")
def q_fill(spark, sf_dir):
    """Leftover missing -> 0, +/-inf -> 0."""
    ev = recode.coerce_numeric(src.table(spark, sf_dir, "events").select(*EV), EV, key="__none__")
    return recode.fill_and_finite(ev, EV, key="__none__")


def _pre_split_sql(kind="split"):
    ch, last = O.preprocessed_chain("median")
    if kind == "split":
        ch.add("sp", _split_sql(last, "patient_id", "CAST(apnea AS INTEGER)"))
        return ch.sql("SELECT patient_id, label, split FROM sp")
    ch.add("fo", f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY u, patient_id) AS rk
  FROM (SELECT *, CAST(apnea AS INTEGER) AS label, {_u_sql('patient_id', 'fold')} AS u FROM {last})""")
    return ch.sql("SELECT patient_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM fo")


def _labelled(spark, sf_dir):
    return _preprocessed(spark, sf_dir).select("patient_id", F.col("apnea").cast("int").alias("label"))


@query("stratified_split", _pre_split_sql("split"))
def q_split(spark, sf_dir):
    """Stratified 80/20 split by md5 rank within each class."""
    return split.stratified_split(_labelled(spark, sf_dir), "label", "patient_id").select(
        "patient_id", "label", "split")


@query("stratified_folds", _pre_split_sql("fold"))
def q_folds(spark, sf_dir):
    """Stratified 5 folds by md5 rank within each class."""
    return split.stratified_folds(_labelled(spark, sf_dir), "label", "patient_id").select(
        "patient_id", "label", "fold")
