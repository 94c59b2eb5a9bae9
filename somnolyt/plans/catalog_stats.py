"""Statistics and sink queries: KDE, Welch test, ANOVA F, mutual information,
PCA, and write/read round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features, mutual, pca, split, stats
from ..session import scratch_path
from ..sources import cohort as src
from ..sources import typed_csv
from . import oracle_sql as O
from .catalog import _PRE_DOUBLES, _preprocessed
from .catalog_eval import MULTI_SQL, scored_multi
from .catalog_matrix import _matrix_sql, _pre_split_sql, _split_sql
from .matrix import fit_model_matrix, to_tall
from .registry import query


def _kde_sql(prefix_ctes: str, source: str, by: list[str]) -> str:
    g = ", ".join(by)
    gsel = (g + ", ") if by else ""
    on = " AND ".join(f"s.{b} = p.{b}" for b in by) or "TRUE"
    return f"""WITH {prefix_ctes}
kst AS (SELECT {gsel}count(v) AS n, stddev_samp(v) AS sd, min(v) AS mn, max(v) AS mx FROM {source}
        WHERE v IS NOT NULL GROUP BY ALL HAVING count(v) >= 2 AND stddev_samp(v) > 0),
kp AS (SELECT *, sd * pow(n, -0.2) AS h FROM kst),
kg AS (SELECT {gsel}n, h, i AS point, (mn - 3.0 * h) + i * (((mx + 3.0 * h) - (mn - 3.0 * h)) / 199) AS x
       FROM kp CROSS JOIN range(200) t(i))
SELECT {', '.join(f'p.{b}' for b in by) + ', ' if by else ''}CAST(point AS INTEGER) AS point, round(x, 6) AS x,
  round(sum(exp(-0.5 * ((x - s.v) / h) * ((x - s.v) / h))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM kg p JOIN {source} s ON {on} WHERE s.v IS NOT NULL
GROUP BY {', '.join(f'p.{b}' for b in by) + ', ' if by else ''}point, x, n, h"""


@query("kde", _kde_sql("ev AS (SELECT value AS v FROM events),", "ev", []))
def q_kde(spark, sf_dir):
    """Gaussian KDE (Scott bandwidth, 200 points, cut 3) of events.value."""
    return stats.kde(src.table(spark, sf_dir, "events").select(F.col("value").alias("v")), "v")


@query("score_kde", _kde_sql(MULTI_SQL + ",\nsl AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS class, label, p{c} AS v FROM multi" for c in range(4)) + "),", "sl", ["class", "label"]))
def q_score_kde(spark, sf_dir):
    """Density of each class's score by true class (multi-class)."""
    m = scored_multi(spark, sf_dir)
    long = m.select("label", F.explode(F.array(*[
        F.struct(F.lit(str(c)).alias("class"), F.col(f"p{c}").alias("v")) for c in range(4)])).alias("t")).select(
        "t.class", "label", "t.v")
    return stats.kde(long, "v", by=["class", "label"])


def _grouped_kde_sql(rows: str, by: list[str]) -> str:
    """KDE of ``rows`` (a SELECT of by... and v over the preprocessed cohort)."""
    ch, last = O.preprocessed_chain("median")
    ch.add("gv", rows.format(src=last))
    return _kde_sql(ch.sql("")[len("WITH "):].rstrip() + ",", "gv", by)


PAIR_DENSITY = ["nsrr_age", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_ahi_hp3r_aasm15"]


@query("kde_by_gender", _grouped_kde_sql("""SELECT * FROM (SELECT CASE WHEN CAST(nsrr_sex AS INTEGER) = 1 THEN 'Male'
  WHEN CAST(nsrr_sex AS INTEGER) = 0 THEN 'Female' END AS gender_label, CAST(nsrr_ahi_hp3r_aasm15 AS DOUBLE) AS v
FROM {src}) WHERE gender_label IS NOT NULL""", ["gender_label"]))
def q_kde_by_gender(spark, sf_dir):
    """Density of AHI by gender."""
    df = features.gender_labels(_preprocessed(spark, sf_dir)).filter(F.col("gender_label").isNotNull())
    return stats.kde(df.select("gender_label", F.col("nsrr_ahi_hp3r_aasm15").alias("v")), "v", by=["gender_label"])


@query("pair_density", _grouped_kde_sql("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, apnea_severity, CAST({c} AS DOUBLE) AS v FROM {{src}}" for c in PAIR_DENSITY)
    + ") WHERE apnea_severity IS NOT NULL", ["variable", "apnea_severity"]))
def q_pair_density(spark, sf_dir):
    """Densities on the pair plot's diagonal, by severity."""
    long = _preprocessed(spark, sf_dir).filter(F.col("apnea_severity").isNotNull()).select("apnea_severity", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in PAIR_DENSITY])).alias("t"))
    return stats.kde(long.select("t.variable", "apnea_severity", "t.v"), "v", by=["variable", "apnea_severity"])


WELCH_VARS = ["nsrr_age", "nsrr_bmi", "nsrr_ahi_hp3r_aasm15"]


def _welch_sql():
    ch, last = O.preprocessed_chain("median")
    ch.add("dg", f"""SELECT *, CASE WHEN apnea_central = 1 THEN 'Central' ELSE 'Obstructiva' END AS tipo
FROM {last} WHERE apnea_central = 1 OR apnea_obstructiva = 1""")
    parts = []
    for v in WELCH_VARS:
        parts.append(f"""SELECT '{v}' AS variable, count({v}) FILTER (WHERE tipo = 'Central') AS n1,
  count({v}) FILTER (WHERE tipo = 'Obstructiva') AS n2, avg({v}) FILTER (WHERE tipo = 'Central') AS mean1,
  avg({v}) FILTER (WHERE tipo = 'Obstructiva') AS mean2, var_samp({v}) FILTER (WHERE tipo = 'Central') AS var1,
  var_samp({v}) FILTER (WHERE tipo = 'Obstructiva') AS var2 FROM dg""")
    ch.add("wg", "\nUNION ALL\n".join(parts))
    return ch.sql("""SELECT variable, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(mean1, 6) AS mean1,
  round(mean2, 6) AS mean2, round(var1, 6) AS var1, round(var2, 6) AS var2,
  round(CASE WHEN n1 > 1 AND n2 > 1 THEN (mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) END, 6) AS t,
  round(CASE WHEN n1 > 1 AND n2 > 1 THEN (var1 / n1 + var2 / n2) * (var1 / n1 + var2 / n2)
        / ((var1 / n1) * (var1 / n1) / (n1 - 1) + (var2 / n2) * (var2 / n2) / (n2 - 1)) END, 6) AS df FROM wg""")


def _welch(spark, sf_dir):
    dg = features.differential_groups(_preprocessed(spark, sf_dir))
    return stats.welch_ttest(dg, "tipo_apnea", WELCH_VARS, "Central", "Obstructiva")


@query("welch_ttest", _welch_sql())
def q_welch(spark, sf_dir):
    """Welch t statistic and degrees of freedom, central vs obstructive."""
    return _welch(spark, sf_dir)


@query("welch_pvalue")
def q_welch_p(spark, sf_dir):
    """Two-sided p-value (incomplete beta) on the aggregated test rows."""
    w = _welch(spark, sf_dir)
    return w.select("variable", "t", "df", stats.t_pvalue(F.col("t"), F.col("df")).alias("p_value"))


def _scaled_tall_sql(final: str) -> str:
    ch = _matrix_sql()
    ch.add("mm", """SELECT patient_id, CAST(label AS INTEGER) AS label, feature,
  (raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END AS value FROM tall JOIN sc USING (feature)""")
    return ch.sql(final)


def _tall_matrix(spark, sf_dir):
    m, params = fit_model_matrix(_preprocessed(spark, sf_dir), "binario")
    return to_tall(m, params.features, keep=["label"]), m, params


@query("anova_f_scores", _scaled_tall_sql("""SELECT feature,
  round(CASE WHEN ssw = 0 OR k < 2 THEN NULL ELSE (ssb / (k - 1)) / (ssw / (N - k)) END, 6) AS f_score FROM (
  SELECT p.feature, sum(p.n * (p.m - t.M) * (p.m - t.M)) AS ssb, sum(coalesce((p.n - 1) * p.v, 0)) AS ssw,
         count(*) AS k, any_value(t.N) AS N
  FROM (SELECT feature, label, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM mm GROUP BY feature, label) p
  JOIN (SELECT feature, count(value) AS N, avg(value) AS M FROM mm GROUP BY feature) t USING (feature)
  GROUP BY p.feature)"""))
def q_anova(spark, sf_dir):
    """H5: one-way ANOVA F of every model-matrix feature against the label."""
    tall, _, _ = _tall_matrix(spark, sf_dir)
    return stats.anova_f(tall)


@query("mutual_information", _scaled_tall_sql("""SELECT feature, round(sum(pxy * ln(pxy / (px * py))), 6) AS mutual_info FROM (
  SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS pxy,
    sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER (PARTITION BY feature) AS px,
    sum(n) OVER (PARTITION BY feature, label) / sum(n) OVER (PARTITION BY feature) AS py
  FROM (SELECT feature, bin, label, count(*) AS n FROM (
    SELECT m.feature, m.label, len(list_filter(q.dec, lambda d: d < m.value)) AS bin
    FROM mm m JOIN (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS dec
                    FROM mm GROUP BY feature) q USING (feature))
  GROUP BY feature, bin, label)) GROUP BY feature"""))
def q_mi(spark, sf_dir):
    """H6: mutual information between decile-binned features and the label."""
    tall, _, _ = _tall_matrix(spark, sf_dir)
    return stats.mutual_information(tall)


def _digamma_sql(n: str) -> str:
    y = f"(CAST({n} AS DOUBLE) + 6)"
    z = f"(1 / ({y} * {y}))"
    steps = " ".join(f"- 1 / (CAST({n} AS DOUBLE) + {i})" for i in range(6))
    return (f"(ln({y}) - 0.5 / {y} - {z} * (1 / CAST(12 AS DOUBLE) - {z} * (1 / CAST(120 AS DOUBLE) - {z} * (1 / CAST(252 AS DOUBLE)"
            f" - {z} * (1 / CAST(240 AS DOUBLE) - {z} / 132)))) {steps})")


def _mi_knn_sql(k: int = 3) -> str:
    ch = _matrix_sql()
    ch.add("mm", """SELECT feature, CAST(label AS INTEGER) AS label,
  (raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END + 0.0 AS v FROM tall JOIN sc USING (feature)
  WHERE label IS NOT NULL AND raw IS NOT NULL""")
    ch.add("vals", """SELECT *, sum(c) OVER (PARTITION BY feature, label) AS n FROM (
  SELECT feature, label, v, count(*) AS c FROM mm GROUP BY ALL) QUALIFY n > 1""")
    ch.add("near", f"""SELECT feature, label, v, least({k}, n - 1) AS kk, c, n, d,
  sum(k) OVER (PARTITION BY feature, label, v ORDER BY d) AS seen FROM (
  SELECT a.feature, a.label, a.v, a.c, a.n, abs(a.v - b.v) AS d, b.c - CAST(a.v = b.v AS INTEGER) AS k
  FROM vals a JOIN vals b ON a.feature = b.feature AND a.label = b.label)""")
    ch.add("radii", "SELECT feature, label, v, kk, c, n, min(d) FILTER (WHERE seen >= kk) AS r FROM near GROUP BY feature, label, v, kk, c, n")
    ch.add("around", """SELECT r.feature, r.label, r.v, r.kk, r.c, r.n, sum(p.c) AS m
  FROM radii r JOIN (SELECT feature, v, sum(c) AS c FROM vals GROUP BY ALL) p ON p.feature = r.feature
   AND CASE WHEN r.r = 0 THEN p.v = r.v ELSE p.v > r.v - r.r AND p.v < r.v + r.r END
  GROUP BY r.feature, r.label, r.v, r.kk, r.c, r.n""")
    return ch.sql(f"""SELECT feature, round(greatest(CAST(0 AS DOUBLE), {_digamma_sql('sum(c)')}
  + sum(c * ({_digamma_sql('kk')} - {_digamma_sql('n')} - {_digamma_sql('m')})) / sum(c)), 6) AS mutual_info
FROM around GROUP BY feature""")


@query("mutual_information_knn", _mi_knn_sql())
def q_mi_knn(spark, sf_dir):
    """H6: mutual information of every feature and the label by nearest neighbours."""
    tall, _, _ = _tall_matrix(spark, sf_dir)
    return mutual.mutual_information_knn(tall)


def _pca_chain(squarings: int = 14):
    """Two components by squaring the covariance until its first eigenvector is
    all that is left, then the same on what that one does not explain."""
    ch = _matrix_sql()
    ch.add("mm", """SELECT patient_id, feature, (raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END AS value
FROM tall JOIN sc USING (feature)""")
    ch.add("dev", "SELECT patient_id, feature, value - avg(value) OVER (PARTITION BY feature) AS x FROM mm")
    ch.add("cov0", """SELECT a.feature AS i, b.feature AS j, sum(a.x * b.x) / (count(*) - 1) AS v
FROM dev a JOIN dev b USING (patient_id) GROUP BY ALL""", stored=True)
    for c in range(2):
        ch.add(f"s{c}_0", f"SELECT i, j, v / max(abs(v)) OVER () AS v FROM cov{c}", stored=True)
        for k in range(squarings):
            ch.add(f"s{c}_{k + 1}", f"""SELECT i, j, v / max(abs(v)) OVER () AS v FROM (
  SELECT a.i, b.j, sum(a.v * b.v) AS v FROM s{c}_{k} a JOIN s{c}_{k} b ON a.j = b.i GROUP BY ALL)""", stored=True)
        ch.add(f"u{c}", f"""SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM s{c}_{squarings}
WHERE j = (SELECT i FROM s{c}_{squarings} WHERE i = j ORDER BY v DESC, i LIMIT 1)""")
        ch.add(f"v{c}", f"SELECT i, v * (SELECT sign(v) FROM u{c} ORDER BY round(abs(v), 9) DESC, i LIMIT 1) AS v FROM u{c}")
        ch.add(f"lam{c}", f"SELECT sum(a.v * m.v * b.v) AS l FROM cov{c} m JOIN v{c} a ON a.i = m.i JOIN v{c} b ON b.i = m.j")
        ch.add(f"cov{c + 1}", f"""SELECT m.i, m.j, m.v - l * a.v * b.v AS v
FROM cov{c} m JOIN v{c} a ON a.i = m.i JOIN v{c} b ON b.i = m.j CROSS JOIN lam{c}""", stored=True)
    ch.add("vecs", "SELECT 0 AS component, i, v, l FROM v0 CROSS JOIN lam0 UNION ALL SELECT 1, i, v, l FROM v1 CROSS JOIN lam1")
    return ch


def _pca_fit(spark, sf_dir):
    m, params = fit_model_matrix(_preprocessed(spark, sf_dir), "binario")
    return m, pca.fit(m, params.features, 2)


@query("pca_projection", _pca_chain().sql("""SELECT patient_id, CAST(component AS INTEGER) AS component, round(sum(mm.value * vecs.v), 6) AS value
FROM mm JOIN vecs ON mm.feature = vecs.i GROUP BY patient_id, component"""))
def q_pca(spark, sf_dir):
    """H7: first two principal components of the robust-scaled matrix."""
    m, found = _pca_fit(spark, sf_dir)
    return found.project(m, ["patient_id"])


@query("pca_components", _pca_chain().sql("""SELECT CAST(component AS INTEGER) AS component, i AS feature, round(v, 6) AS loading,
  round(l, 6) AS variance, round(l / (SELECT sum(v) FROM cov0 WHERE i = j), 6) AS share FROM vecs"""))
def q_pca_components(spark, sf_dir):
    """H7: loadings, variances and explained shares of the two components."""
    return _pca_fit(spark, sf_dir)[1].table(spark)


@query("quarantine_load", f"""WITH cohort AS ({src.cohort_sql()}),
t AS (SELECT patient_id, patient_id % 211 = 5 AS age_bad, patient_id % 223 = 7 AS pressure_bad, patient_id % 227 = 9 AS ragged FROM cohort)
SELECT patient_id, CASE WHEN ragged THEN 'fields' WHEN age_bad OR pressure_bad THEN 'value' ELSE 'typed' END AS status,
  CASE WHEN ragged THEN '' WHEN age_bad AND pressure_bad THEN 'nsrr_age,nsrr_bp_systolic' WHEN age_bad THEN 'nsrr_age'
       WHEN pressure_bad THEN 'nsrr_bp_systolic' ELSE '' END AS unfit,
  CASE WHEN NOT (ragged OR age_bad OR pressure_bad) THEN nsrr_age END AS nsrr_age FROM t JOIN cohort USING (patient_id)""")
def q_quarantine(spark, sf_dir):
    """A1: the cohort as CSV text, with unreadable numbers and rows of too many
    fields on fixed patients, read with inferred types and a quarantine."""
    who, text = F.col("patient_id"), []
    for name in ("patient_id", "nsrr_age", "nsrr_bp_systolic", "nsrr_sex"):
        bad = {"nsrr_age": who % 211 == 5, "nsrr_bp_systolic": who % 223 == 7}.get(name, F.lit(False))
        value = F.when(bad, F.lit("n.m.")).otherwise(F.coalesce(F.col(name).cast("string"), F.lit("")))
        text.append(value)
    line = F.concat(F.concat_ws(",", *text), F.when(who % 227 == 9, ",more").otherwise(""))
    path = scratch_path(spark, f"sink/raw-{uuid.uuid4().hex}")
    src.cohort(spark, sf_dir).select(line.alias("value")).write.text(path)
    got = typed_csv.read_typed(spark, path, names=["patient_id", "nsrr_age", "nsrr_bp_systolic", "nsrr_sex"])
    rows = got.rows.select("patient_id", F.lit("typed").alias("status"), F.lit("").alias("unfit"), F.col("nsrr_age").cast("double"))
    ident = F.coalesce(F.get_json_object("record", "$.patient_id"), F.split("record", ",")[0]).cast("long")
    return rows.unionByName(got.quarantine.select(ident.alias("patient_id"), F.col("reason").alias("status"),
                                                  F.array_join("columns", ",").alias("unfit"), F.lit(None).cast("double").alias("nsrr_age")))


@query("sink_roundtrip", O.preprocessed_chain("median")[0].sql(
    O.rounded_select(O.PREPROCESSED_COLUMNS, _PRE_DOUBLES, O.preprocessed_chain("median")[1])))
def q_sink(spark, sf_dir):
    """A1/A4: preprocessed cohort written as CSV and read back with the loader."""
    df = _preprocessed(spark, sf_dir).select(*O.PREPROCESSED_COLUMNS)
    path = scratch_path(spark, f"sink/preprocessed-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("header", True).csv(path)
    return src.load_cohort(spark, path, "csv", schema=df.schema)


@query("sink_splits", _pre_split_sql("split"))
def q_sink_splits(spark, sf_dir):
    """train/test keys and labels written partitioned by split (Parquet) and read back."""
    lab = _preprocessed(spark, sf_dir).select("patient_id", F.col("apnea").cast("int").alias("label"))
    sp = split.stratified_split(lab, "label", "patient_id")
    path = scratch_path(spark, f"sink/splits-{uuid.uuid4().hex}")
    sp.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("patient_id", "label", "split")


_LAST = O.preprocessed_chain("median")[1]


def _sink_xy_sql():
    parts = []
    for mode, label in (("binario", "apnea"), ("multiclase", "apnea_severity_ordinal")):
        parts.append("SELECT * FROM (" + _matrix_sql(label).sql(f"""SELECT '{mode}' AS mode, patient_id,
  CAST(label AS INTEGER) AS label, feature,
  round((raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END, 6) AS value FROM tall JOIN sc USING (feature)""") + ")")
    return "\nUNION ALL\n".join(parts)


@query("sink_xy", _sink_xy_sql())
def q_sink_xy(spark, sf_dir):
    """A5: feature matrix and label of each mode, written as Parquet partitioned
    by mode and read back (long form)."""
    pre, path, names = _preprocessed(spark, sf_dir), scratch_path(spark, f"sink/xy-{uuid.uuid4().hex}"), []
    for mode in ("binario", "multiclase"):
        m, params = fit_model_matrix(pre, mode)
        names = params.features
        m.write.parquet(f"{path}/mode={mode}")
    return to_tall(spark.read.parquet(path), names, keep=["mode", "label"])


def _split_matrix_sql():
    ch = _matrix_sql()
    ch.add("sp", _split_sql(_LAST, "patient_id", "CAST(apnea AS INTEGER)"))
    return ch.sql("""SELECT tall.patient_id, CAST(tall.label AS INTEGER) AS label, sp.split, feature,
  round((raw - med) / CASE WHEN q3 - q1 = 0 THEN 1 ELSE q3 - q1 END, 6) AS value
FROM tall JOIN sc USING (feature) JOIN sp ON sp.patient_id = tall.patient_id""")


@query("sink_split_matrix", _split_matrix_sql())
def q_sink_split_matrix(spark, sf_dir):
    """Full train and test rows (features and label) written partitioned by
    split and read back (long form)."""
    m, params = fit_model_matrix(_preprocessed(spark, sf_dir), "binario")
    path = scratch_path(spark, f"sink/split-matrix-{uuid.uuid4().hex}")
    split.stratified_split(m, "label", "patient_id").write.partitionBy("split").parquet(path)
    return to_tall(spark.read.parquet(path), params.features, keep=["label", "split"])


CMP_NUM = ["nsrr_age", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_bp_diastolic"]
CMP_CAT = ["nsrr_sex", "nsrr_current_smoker", "nsrr_ever_smoker", "nsrr_race", "nsrr_ethnicity"]
_GRP_SQL = "CASE WHEN nsrr_ahi_hp3r_aasm15 < 5 THEN 'AHI < 5' WHEN nsrr_ahi_hp3r_aasm15 >= 5 THEN 'AHI >= 5' END"


def _comparison_sql():
    ch = O.cohort_chain().add("cg", f"SELECT *, {_GRP_SQL} AS grp FROM cohort WHERE {_GRP_SQL} IS NOT NULL")
    cat = "\nUNION ALL\n".join(f"SELECT grp, '{c}' AS feature, CAST({c} AS VARCHAR) AS level FROM cg" for c in CMP_CAT)
    num = "\nUNION ALL\n".join(f"SELECT grp, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM cg" for c in CMP_NUM)
    ch.add("catlong", cat)
    ch.add("numlong", num)
    ch.add("cell", "SELECT feature, level, grp, count(*) AS o FROM catlong WHERE level IS NOT NULL GROUP BY ALL")
    ch.add("lev", "SELECT feature, level, sum(o) AS r FROM cell GROUP BY ALL")
    ch.add("gro", "SELECT feature, grp, sum(o) AS c FROM cell GROUP BY ALL")
    ch.add("size", "SELECT feature, sum(r) AS n, count(*) AS nr, (SELECT count(*) FROM gro WHERE gro.feature = lev.feature) AS nc FROM lev GROUP BY feature")
    ch.add("grid", """SELECT lev.feature, nr, nc, r * c / CAST(n AS DOUBLE) AS e, abs(coalesce(o, 0) - r * c / CAST(n AS DOUBLE)) AS off
  FROM lev JOIN gro USING (feature) JOIN size USING (feature)
  LEFT JOIN cell ON cell.feature = lev.feature AND cell.level = lev.level AND cell.grp = gro.grp""")
    ch.add("chi", """SELECT feature, CASE WHEN (nr - 1) * (nc - 1) > 0 THEN sum(pow(off - CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, off) ELSE 0 END, 2) / e) END AS statistic,
  CASE WHEN (nr - 1) * (nc - 1) > 0 THEN CAST((nr - 1) * (nc - 1) AS DOUBLE) END AS dof FROM grid GROUP BY feature, nr, nc""")
    ch.add("per", "SELECT feature, grp, count(v) AS n, avg(v) AS m, var_samp(v) / count(v) AS s FROM numlong GROUP BY ALL")
    ch.add("welch", """SELECT a.feature, (a.m - b.m) / sqrt(a.s + b.s) AS statistic,
  pow(a.s + b.s, 2) / (a.s * a.s / (a.n - 1) + b.s * b.s / (b.n - 1)) AS dof
  FROM per a JOIN per b ON a.feature = b.feature AND a.grp = 'AHI < 5' AND b.grp = 'AHI >= 5'""")
    parts = ["""SELECT feature, CAST(NULL AS VARCHAR) AS level, grp, CAST(count(v) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS n_missing, round(avg(v), 6) AS mean,
  round(stddev_samp(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, CAST(NULL AS DOUBLE) AS pct,
  round(any_value(w.statistic), 6) AS statistic, round(any_value(w.dof), 6) AS dof
FROM numlong JOIN welch w USING (feature) GROUP BY feature, grp"""]
    parts.append("""SELECT feature, level, grp, CAST(n AS BIGINT) AS n, CAST(NULL AS BIGINT) AS n_missing,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS median,
  round(n * CAST(100 AS DOUBLE) / sum(n) OVER (PARTITION BY feature, grp), 6) AS pct,
  round(chi.statistic, 6) AS statistic, round(chi.dof, 6) AS dof
FROM (SELECT feature, level, grp, count(*) AS n FROM catlong GROUP BY feature, level, grp) JOIN chi USING (feature)""")
    return ch.sql("\nUNION ALL\n".join(parts))


@query("comparison_table", _comparison_sql())
def q_comparison(spark, sf_dir):
    """Nine features compared between AHI < 5 and AHI >= 5 (raw cohort)."""
    from pyspark.sql import functions as Fn
    ahi = Fn.col("nsrr_ahi_hp3r_aasm15")
    grp = Fn.when(ahi < 5, "AHI < 5").when(ahi >= 5, "AHI >= 5")
    return stats.comparison_table(src.cohort(spark, sf_dir), grp, CMP_NUM, CMP_CAT).drop("p")


@query("comparison_pvalues")
def q_comparison_pvalues(spark, sf_dir):
    """The p-values of the comparison table's tests, one row a feature
    (no distribution function in SQL)."""
    ahi = F.col("nsrr_ahi_hp3r_aasm15")
    grp = F.when(ahi < 5, "AHI < 5").when(ahi >= 5, "AHI >= 5")
    table = stats.comparison_table(src.cohort(spark, sf_dir), grp, CMP_NUM, CMP_CAT)
    return table.select("feature", "statistic", "dof", "p").distinct()
