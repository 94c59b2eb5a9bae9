"""Model matrix (H8) and its train/serve-parity apply step."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clinical as C
from ..operators import encode, features, recode
from ..sources.cohort import KEY

# Targets and target sources never used as features.
EXCLUDED = ["apnea", "nsrr_ahi_hp4u_aasm15", "apnea_severity", "apnea_severity_ordinal",
            "nsrr_ahi_hp3r_aasm15"]
CATEGORICAL = ["bmi_categoria", "categoria_pa"]
ORDERED_LEVELS = {"bmi_categoria": C.BMI_LABELS}
TARGETS = {"binario": "apnea", "multiclase": "apnea_severity_ordinal"}


@dataclass
class MatrixParams:
    mode: str
    features: list[str] = field(default_factory=list)
    rare: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)
    scaling: encode.Scaling = field(default_factory=encode.Scaling)

    def to_json(self) -> str:
        return json.dumps({"mode": self.mode, "features": self.features, "rare": self.rare,
                           "levels": self.levels, "center": self.scaling.center,
                           "scale": self.scaling.scale})

    @staticmethod
    def from_json(text: str) -> "MatrixParams":
        d = json.loads(text)
        return MatrixParams(d["mode"], d["features"], d["rare"], d["levels"],
                            encode.Scaling(d["center"], d["scale"]))


def select_target(df: DataFrame, mode: str = "binario") -> str:
    missing = [c for c in TARGETS.values() if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    if mode not in TARGETS:
        raise ValueError("mode must be 'multiclase' or 'binario'")
    return TARGETS[mode]


def _encode(df: DataFrame, key: str, params: MatrixParams) -> DataFrame:
    df = encode.apply_rare_categories(df, params.rare)
    df = encode.one_hot(df, params.levels)
    return df


def _usable(kind: T.DataType) -> bool:
    """Numbers, flags and text become features; dates, arrays and the like do not."""
    return isinstance(kind, (T.NumericType, T.BooleanType, T.StringType))


def fit_model_matrix(df: DataFrame, mode: str = "binario", key: str = KEY) -> tuple[DataFrame, MatrixParams]:
    """Returns (matrix, params): ``key, features..., label`` with robust-scaled
    features, and the fitted levels / medians / ranges for scoring."""
    target = select_target(df, mode)
    label = F.col(target).cast("int").alias("label")
    X = df.select(key, *[f.name for f in df.schema.fields
                         if f.name not in EXCLUDED and f.name != key and _usable(f.dataType)], label)
    text = [f.name for f in X.schema.fields if isinstance(f.dataType, T.StringType) and f.name != key]
    cats = [c for c in CATEGORICAL if c in X.columns] + [c for c in text if c not in CATEGORICAL]
    params = MatrixParams(mode)
    params.rare = encode.fit_rare_categories(X, cats)
    Xg = encode.apply_rare_categories(X, params.rare)
    params.levels = encode.fit_levels(Xg, cats, ORDERED_LEVELS)
    Xe = encode.one_hot(Xg, params.levels)
    feats = [c for c in Xe.columns if c not in (key, "label")]
    Xe = recode.coerce_numeric(Xe, feats, key)
    params.features = feats
    params.scaling = encode.fit_robust(Xe, feats)
    return params.scaling.apply(Xe).select(key, *feats, "label"), params


def apply_model_matrix(df: DataFrame, params: MatrixParams, key: str = KEY,
                       fill: bool = True) -> DataFrame:
    """Score-time transform with the training parameters; columns are aligned
    to the saved feature list (absent features are NULL, then 0)."""
    df = features.add_derived_features(recode.recode_categories(df))
    for c in params.levels:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    Xe = _encode(df, key, params)
    cols = [F.col(c).try_cast("double").alias(c) if c in Xe.columns
            else F.lit(None).cast("double").alias(c) for c in params.features]
    X = params.scaling.apply(Xe.select(key, *cols))
    return recode.fill_and_finite(X, params.features, key) if fill else X


def to_tall(matrix: DataFrame, features_: list[str], key: str = KEY,
            keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., feature, value): the matrix in long form."""
    keep = keep or []
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
               for c in features_]
    return matrix.select(key, *keep, F.explode(F.array(*structs)).alias("s")).select(
        key, *keep, "s.feature", "s.value")
