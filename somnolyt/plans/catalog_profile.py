"""Profiling queries (G, F, D4, B11) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, outliers, profile
from ..sources import cohort as src
from . import oracle_sql as O
from .catalog import _preprocessed
from .registry import query

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax"]
COHORT_TEXT = ["nsrr_sex", "nsrr_race", "nsrr_ethnicity", "nsrr_current_smoker", "nsrr_ever_smoker"]
COHORT_ALL = [n for n, _ in src.COHORT_COLUMNS if n != src.KEY]
COHORT_NSRR_NUM = ["nsrr_age", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_bp_diastolic", "nsrr_ahi_hp3r_aasm15"]
CLINICAL = ["nsrr_age", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_bp_diastolic"]
PAIR_VARS = ["nsrr_age", "nsrr_bmi", "nsrr_bp_systolic", "nsrr_ahi_hp3r_aasm15"]
PRE_NUMERIC = O.NUMERIC + ["obesidad", "obesidad_severa", "hipertension", "hipertension_severa",
                           "edad_obesidad_risk", "hombre_edad_media", "clinical_risk_score",
                           "apnea", "apnea_severity_ordinal"]


def _lineitem(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem")


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _d(c):
    return f"CAST({c} AS DOUBLE)"


@query("describe_numeric", _union([
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({_d(c)}), 6) AS mean,
  round(stddev_samp({_d(c)}), 6) AS std, round(min({_d(c)}), 6) AS min,
  round(quantile_cont({_d(c)}, 0.25), 6) AS p25, round(quantile_cont({_d(c)}, 0.5), 6) AS p50,
  round(quantile_cont({_d(c)}, 0.75), 6) AS p75, round(max({_d(c)}), 6) AS max FROM lineitem""" for c in LI_NUM]))
def q_describe_numeric(spark, sf_dir):
    """G1 (numeric): one grouped aggregation over the unpivoted lineitem columns."""
    return profile.describe_numeric(_lineitem(spark, sf_dir), LI_NUM)


def _describe_text_sql():
    ch = O.cohort_chain()
    parts = []
    for i, c in enumerate(COHORT_TEXT):
        ch.add(f"vc{i}", f"SELECT {c} AS value, count(*) AS n FROM cohort WHERE {c} IS NOT NULL GROUP BY {c}")
        parts.append(f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS "unique",
  (SELECT value FROM vc{i} ORDER BY n DESC, value LIMIT 1) AS top, CAST(max(n) AS BIGINT) AS freq FROM vc{i}""")
    return ch.sql(_union(parts))


@query("describe_text", _describe_text_sql())
def q_describe_text(spark, sf_dir):
    """G1 (text): count, unique, top, freq per text column of the raw cohort."""
    return profile.describe_text(src.cohort(spark, sf_dir), COHORT_TEXT)


@query("missing_summary", O.cohort_chain().sql(_union([
    f"""SELECT '{c}' AS "column", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing,
  round(count(*) FILTER (WHERE {c} IS NULL) * CAST(100 AS DOUBLE) / count(*), 6) AS pct_missing FROM cohort"""
    for c in COHORT_ALL])))
def q_missing_summary(spark, sf_dir):
    """Missing count and percent per column."""
    return profile.missing_summary(src.cohort(spark, sf_dir), COHORT_ALL)


_PATTERN_SQL = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in COHORT_ALL)


@query("missing_patterns", O.cohort_chain().sql(f"""SELECT pattern, CAST(count(*) AS BIGINT) AS n,
  CAST(length(replace(pattern, '0', '')) AS INTEGER) AS n_missing
FROM (SELECT {_PATTERN_SQL} AS pattern FROM cohort) GROUP BY pattern"""))
def q_missing_patterns(spark, sf_dir):
    """Missingness pattern counts (the table behind the matrix plot)."""
    return profile.missing_patterns(src.cohort(spark, sf_dir), COHORT_ALL)


def _missing_corr_sql():
    parts = []
    for i in range(len(COHORT_ALL)):
        for j in range(i):
            a, b = COHORT_ALL[i], COHORT_ALL[j]
            parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2,
  round(corr(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)), 6) AS corr FROM cohort
  HAVING count(*) FILTER (WHERE {a} IS NULL) BETWEEN 1 AND count(*) - 1
     AND count(*) FILTER (WHERE {b} IS NULL) BETWEEN 1 AND count(*) - 1""")
    return O.cohort_chain().sql(_union(parts))


@query("missing_correlation", _missing_corr_sql())
def q_missing_corr(spark, sf_dir):
    """Correlation of missingness between sometimes-missing columns."""
    return profile.missing_correlation(src.cohort(spark, sf_dir), COHORT_ALL)


def _corr_matrix_sql():
    parts = []
    for i in range(len(LI_NUM)):
        for j in range(len(LI_NUM)):
            a, b = LI_NUM[i], LI_NUM[j]
            if i == j:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, CAST(1.0 AS DOUBLE) AS corr")
            else:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({_d(a)}, {_d(b)}), 6) AS corr FROM lineitem")
    return _union(parts)


@query("correlation_matrix", _corr_matrix_sql())
def q_corr_matrix(spark, sf_dir):
    """Full Pearson matrix of lineitem numeric columns, one aggregation."""
    return profile.correlation_matrix(_lineitem(spark, sf_dir), LI_NUM)


def _top_corr_sql():
    ch, last = O.preprocessed_chain("median")
    parts = []
    for i in range(len(PRE_NUMERIC)):
        for j in range(i):
            a, b = PRE_NUMERIC[i], PRE_NUMERIC[j]
            parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({_d(a)}, {_d(b)}) AS corr FROM {last}")
    ch.add("pairs", _union(parts))
    return ch.sql("""SELECT var1, var2, round(corr, 6) AS corr, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY round(abs(corr), 6) DESC, var1, var2) AS rank
  FROM pairs WHERE abs(corr) > 0.5) WHERE rank <= 10""")


@query("top_correlations", _top_corr_sql())
def q_top_corr(spark, sf_dir):
    """Strongest correlations (|r| > 0.5), top 10, preprocessed cohort."""
    return profile.top_correlations(_preprocessed(spark, sf_dir), PRE_NUMERIC)


LI_DISTINCT = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount",
               "l_tax", "l_suppkey", "l_partkey"]


@query("distinct_counts", _union([
    f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM lineitem"""
    for c in LI_DISTINCT]))
def q_distinct(spark, sf_dir):
    """exact distinct counts per column."""
    return profile.distinct_counts(_lineitem(spark, sf_dir), LI_DISTINCT)


PART_CATS = ["p_brand", "p_type", "p_size"]


@query("top_categories", _union([
    f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n,
  CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank
  FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 8""" for c in PART_CATS]))
def q_top_categories(spark, sf_dir):
    """top-8 values by frequency per column."""
    return profile.top_values(src.table(spark, sf_dir, "part"), PART_CATS, 8)


@query("select_continuous_columns", O.cohort_chain().sql(
    "SELECT * FROM (" + _union([f"""SELECT '{c}' AS "column", CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM cohort"""
                                for c in COHORT_NSRR_NUM]) + ") WHERE n_distinct > 5"))
def q_continuous(spark, sf_dir):
    """Numeric nsrr_ columns with more than 5 distinct values."""
    df = src.cohort(spark, sf_dir)
    cols = profile.continuous_columns(df)
    return profile.distinct_counts(df, cols).filter(F.col("n_distinct") > 5)


def _quartile_cte(ch, name, table, c, factor=1.5):
    ch.add(name, f"""SELECT quantile_cont({_d(c)}, 0.25) AS q1, quantile_cont({_d(c)}, 0.5) AS med,
  quantile_cont({_d(c)}, 0.75) AS q3 FROM {table}""")
    ch.add(name + "b", f"SELECT *, q1 - {factor} * (q3 - q1) AS lo, q3 + {factor} * (q3 - q1) AS hi FROM {name}")


def _outlier_summary_sql():
    ch = O.cohort_chain()
    parts = []
    for i, c in enumerate(COHORT_NSRR_NUM):
        _quartile_cte(ch, f"q{i}", "cohort", c)
        parts.append(f"""SELECT '{c}' AS "column",
  CAST(count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS BIGINT) AS n_outliers,
  round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) * CAST(100 AS DOUBLE) / count(*), 6) AS pct_outliers,
  round(min({c}) FILTER (WHERE {c} < lo OR {c} > hi), 6) AS min_outlier,
  round(max({c}) FILTER (WHERE {c} < lo OR {c} > hi), 6) AS max_outlier
FROM cohort CROSS JOIN q{i}b""")
    return ch.sql(_union(parts))


@query("outlier_summary", _outlier_summary_sql())
def q_outlier_summary(spark, sf_dir):
    """1.5*IQR outlier profile of the continuous cohort columns."""
    return outliers.outlier_summary(src.cohort(spark, sf_dir), COHORT_NSRR_NUM, 1.5)


def _boxplot_sql():
    ch = O.cohort_chain()
    parts = []
    for i, c in enumerate(COHORT_NSRR_NUM):
        _quartile_cte(ch, f"q{i}", "cohort", c)
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS n, round(any_value(q1), 6) AS q1,
  round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min({c}) FILTER (WHERE {c} >= lo AND {c} <= hi), 6) AS whisker_low,
  round(max({c}) FILTER (WHERE {c} >= lo AND {c} <= hi), 6) AS whisker_high,
  CAST(count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS BIGINT) AS n_fliers
FROM cohort CROSS JOIN q{i}b WHERE {c} IS NOT NULL""")
    return ch.sql(_union(parts))


@query("boxplot_stats", _boxplot_sql())
def q_boxplot(spark, sf_dir):
    """Box-plot numbers per continuous cohort column."""
    return profile.boxplot_stats(src.cohort(spark, sf_dir), COHORT_NSRR_NUM)


def _boxplot_by_sql(by="apnea_severity", groups=None):
    """``groups`` turns the preprocessed cohort into the grouped table."""
    ch, last = O.preprocessed_chain("median")
    if groups:
        ch.add("grouped", groups.format(src=last))
        last = "grouped"
    parts = []
    for i, c in enumerate(CLINICAL):
        ch.add(f"bq{i}", f"""SELECT {by}, quantile_cont({_d(c)}, 0.25) AS q1, quantile_cont({_d(c)}, 0.5) AS med,
  quantile_cont({_d(c)}, 0.75) AS q3 FROM {last} WHERE {c} IS NOT NULL GROUP BY {by}""")
        ch.add(f"bb{i}", f"SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bq{i}")
        parts.append(f"""SELECT t.{by}, '{c}' AS "column", CAST(count(*) AS BIGINT) AS n,
  round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min({c}) FILTER (WHERE {c} >= lo AND {c} <= hi), 6) AS whisker_low,
  round(max({c}) FILTER (WHERE {c} >= lo AND {c} <= hi), 6) AS whisker_high,
  CAST(count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS BIGINT) AS n_fliers
FROM {last} t JOIN bb{i} b ON t.{by} IS NOT DISTINCT FROM b.{by}
WHERE {c} IS NOT NULL GROUP BY t.{by}""")
    return ch.sql(_union(parts))


@query("boxplot_by_severity", _boxplot_by_sql())
def q_boxplot_by(spark, sf_dir):
    """Box-plot numbers per severity group and clinical variable."""
    return profile.boxplot_stats(_preprocessed(spark, sf_dir), CLINICAL, by=["apnea_severity"])


_TYPE_SQL = """SELECT *, CASE WHEN apnea_central = 1 THEN 'Central' WHEN apnea_central = 0 THEN 'Obstructiva' END AS tipo_apnea
FROM {src} WHERE apnea_central = 1 OR apnea_obstructiva = 1"""


@query("boxplot_by_type", _boxplot_by_sql("tipo_apnea", _TYPE_SQL))
def q_boxplot_by_type(spark, sf_dir):
    """Box-plot numbers for central against obstructive apnea."""
    df = features.differential_groups(_preprocessed(spark, sf_dir))
    return profile.boxplot_stats(df, CLINICAL, by=["tipo_apnea"])


def _hist_sql(table: str, col: str, by: str | None, ch=None):
    ch = ch or O.Chain()
    ch.add("hs", f"""SELECT min({_d(col)}) AS mn, max({_d(col)}) AS mx, count({col}) AS n,
  quantile_cont({_d(col)}, 0.25) AS q1, quantile_cont({_d(col)}, 0.75) AS q3 FROM {table}""")
    ch.add("hw", """SELECT *, mx - mn AS ptp,
  (mx - mn) / (log2(n) + CAST(1 AS DOUBLE)) AS sturges,
  CAST(2 AS DOUBLE) * (q3 - q1) * pow(n, CAST(-1 AS DOUBLE) / 3) AS fd FROM hs""")
    ch.add("hn", """SELECT mn, CASE WHEN mx > mn THEN mx - mn ELSE CAST(1 AS DOUBLE) END AS span,
  CASE WHEN n = 0 OR ptp = 0 THEN 1
       ELSE greatest(1, CAST(ceil(ptp / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END)) AS INTEGER)) END AS nb
FROM hw""")
    g = f"{by}, " if by else ""
    ch.add("hb", f"""SELECT {g}least(CAST(floor(({_d(col)} - mn) / span * nb) AS INTEGER), nb - 1) AS bin, mn, span, nb
FROM {table} CROSS JOIN hn WHERE {col} IS NOT NULL""")
    part = f"PARTITION BY {by}" if by else ""
    return ch.sql(f"""SELECT {g}bin, round(mn + bin * (span / nb), 6) AS lower,
  round(mn + (bin + 1) * (span / nb), 6) AS upper, CAST(n AS BIGINT) AS n,
  round(n / (sum(n) OVER ({part}) * (span / nb)), 6) AS density
FROM (SELECT {g}bin, any_value(mn) AS mn, any_value(span) AS span, any_value(nb) AS nb, count(*) AS n
      FROM hb GROUP BY {g}bin)""")


@query("histogram", _hist_sql("events", "value", None))
def q_histogram(spark, sf_dir):
    """Histogram of events.value with the numpy 'auto' bin rule, density."""
    return profile.histogram(src.table(spark, sf_dir, "events"), "value")


def _hist_by_sql():
    ch, last = O.preprocessed_chain("median")
    ch.add("gl", f"""SELECT *, CASE WHEN CAST(nsrr_sex AS INTEGER) = 1 THEN 'Male'
  WHEN CAST(nsrr_sex AS INTEGER) = 0 THEN 'Female' END AS gender_label FROM {last}""")
    return _hist_sql("gl", "nsrr_ahi_hp3r_aasm15", "gender_label", ch)


@query("histogram_by_group", _hist_by_sql())
def q_histogram_by(spark, sf_dir):
    """AHI histogram by gender, common bins, each group normalised alone."""
    df = features.gender_labels(_preprocessed(spark, sf_dir))
    return profile.histogram(df, "nsrr_ahi_hp3r_aasm15", by=["gender_label"])


def _pair_bins_sql():
    ch, last = O.preprocessed_chain("median")
    mm = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in PAIR_VARS)
    ch.add("pm", f"SELECT {mm} FROM {last}")

    def b(c):
        return (f"least(CAST(floor(({c} - mn_{c}) / (CASE WHEN mx_{c} > mn_{c} THEN mx_{c} - mn_{c} "
                f"ELSE CAST(1 AS DOUBLE) END) * 10) AS INTEGER), 9)")
    parts = []
    for i in range(len(PAIR_VARS)):
        for j in range(i + 1, len(PAIR_VARS)):
            a, c = PAIR_VARS[i], PAIR_VARS[j]
            parts.append(f"""SELECT apnea_severity, '{a}' AS var_x, '{c}' AS var_y, {b(a)} AS bin_x, {b(c)} AS bin_y,
  CAST(count(*) AS BIGINT) AS n FROM {last} CROSS JOIN pm WHERE {a} IS NOT NULL AND {c} IS NOT NULL
  GROUP BY ALL""")
    return ch.sql(_union(parts))


@query("pairwise_bins", _pair_bins_sql())
def q_pairwise_bins(spark, sf_dir):
    """10x10 binned counts per predictor pair and severity (pair-plot table)."""
    return profile.binned_pairs(_preprocessed(spark, sf_dir), PAIR_VARS, 10, by=["apnea_severity"])


@query("gender_labels", O.cohort_chain().sql("""SELECT patient_id,
  CASE WHEN nsrr_sex = 'male' THEN 1 WHEN nsrr_sex = 'female' THEN 0 END AS gender_numeric,
  CASE WHEN nsrr_sex = 'male' THEN 'Male' WHEN nsrr_sex = 'female' THEN 'Female' END AS gender_label
FROM cohort"""))
def q_gender(spark, sf_dir):
    """Case-sensitive gender code and label on the raw cohort."""
    return features.gender_labels(src.cohort(spark, sf_dir)).select(
        "patient_id", "gender_numeric", "gender_label")


@query("differential_groups", O.cohort_chain().sql("""SELECT patient_id, apnea_central, apnea_obstructiva,
  CASE WHEN apnea_central = 1 THEN 'Central' WHEN apnea_central = 0 THEN 'Obstructiva' END AS tipo_apnea
FROM cohort WHERE apnea_central = 1 OR apnea_obstructiva = 1"""))
def q_differential(spark, sf_dir):
    """Central or obstructive rows with their type label."""
    return features.differential_groups(src.cohort(spark, sf_dir)).select(
        "patient_id", "apnea_central", "apnea_obstructiva", "tipo_apnea")


def _imbalance_sql():
    ch, last = O.preprocessed_chain("median")
    parts = []
    for mode, col in [("binario", "apnea"), ("multiclase", "apnea_severity_ordinal")]:
        parts.append(f"""SELECT '{mode}' AS mode, CAST(max(n) AS BIGINT) AS n_max, CAST(min(n) AS BIGINT) AS n_min,
  round(max(n) / CAST(min(n) AS DOUBLE), 6) AS ratio, max(n) / CAST(min(n) AS DOUBLE) > 1.5 AS needs_balancing
FROM (SELECT {col}, count(*) AS n FROM {last} GROUP BY {col})""")
    return ch.sql(_union(parts))


@query("imbalance_ratio", _imbalance_sql())
def q_imbalance(spark, sf_dir):
    """Class imbalance ratio per mode and the 1.5 balancing gate."""
    from ..operators.balance import class_counts_ratio
    df = _preprocessed(spark, sf_dir)
    b = class_counts_ratio(df, "apnea").select(F.lit("binario").alias("mode"), "*")
    m = class_counts_ratio(df, "apnea_severity_ordinal").select(F.lit("multiclase").alias("mode"), "*")
    return b.unionByName(m)
