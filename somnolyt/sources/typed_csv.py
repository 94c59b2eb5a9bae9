"""CSV with inferred types and a side table of what does not fit.

Two passes.  The first counts, per column, how many present values read as each
kind; the column gets the first kind of ``KINDS`` that all but a share
``tolerance`` of them fit, else it stays text.  The counts do not depend on how
files are split, so neither do the types.  The second pass casts: a row with too
few or too many fields, or with a value that does not fit its column, goes to the
quarantine with its reason and its fields as JSON; every other row is typed.
Each row is in exactly one of the two.

``multi_line`` reads quoted line breaks; such a file is read by one task, so
large inputs should come as many files or without line breaks in fields.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing (compared trimmed, in lower case).
MISSING = ["", "na", "n/a", "nan", "null"]
_BROKEN = "_broken_row"


def _whole(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def _number(c: Column) -> Column:
    return F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def _truth(c: Column) -> Column:
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


def _day(c: Column) -> Column:
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c.try_cast("date"))


#: Kinds in the order they are tried, each NULL where a text does not fit.
KINDS = {"bigint": _whole, "double": _number, "boolean": _truth, "date": _day}


@dataclass
class Loaded:
    rows: DataFrame
    #: (reason, columns, record): reason 'fields' or 'value'.
    quarantine: DataFrame
    kinds: dict[str, str]


def _present(name: str) -> Column:
    text = F.trim(F.col(f"`{name}`"))
    return F.when(~F.lower(text).isin(*MISSING), text)


def read_typed(spark: SparkSession, path: str, tolerance: float = 0.01, multi_line: bool = True,
               sep: str = ",", names: list[str] | None = None) -> Loaded:
    """Typed rows, quarantined rows and the kind of each column.  Files begin
    with a header unless ``names`` gives the columns."""
    reader = (spark.read.option("header", names is None).option("sep", sep).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"'))
    names = names or reader.csv(path).columns
    if _BROKEN in names:
        raise ValueError(f"a column may not be named {_BROKEN}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    raw = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
           .option("columnPruning", False).csv(path))
    # the reader refuses a query of nothing but its broken-row column (a mere
    # count), so the flag reads a field too, which adds nothing to it
    field = F.col(f"`{names[0]}`")
    whole = F.coalesce(F.col(_BROKEN), F.nullif(field, field)).isNull()
    kinds = _kinds(raw.filter(whole), names, tolerance)
    cast = {n: _present(n) if kinds[n] == "string" else KINDS[kinds[n]](_present(n)) for n in names}
    unfit = F.array_compact(F.array(*[
        F.when(_present(n).isNotNull() & cast[n].isNull(), F.lit(n)) for n in names if kinds[n] != "string"]).cast("array<string>"))
    rows = raw.filter(whole & (F.size(unfit) == 0)).select(*[cast[n].alias(n) for n in names])
    record = F.when(whole, F.to_json(F.struct(*[F.col(f"`{n}`") for n in names]))).otherwise(F.col(_BROKEN))
    quarantine = raw.filter(~whole | (F.size(unfit) > 0)).select(
        F.when(whole, "value").otherwise("fields").alias("reason"),
        F.when(whole, unfit).otherwise(F.array().cast("array<string>")).alias("columns"), record.alias("record"))
    return Loaded(rows, quarantine, kinds)


def _kinds(raw: DataFrame, names: list[str], tolerance: float) -> dict[str, str]:
    counts = []
    for i, n in enumerate(names):
        counts.append(F.count(_present(n)).alias(f"n{i}"))
        counts += [F.count(read(_present(n))).alias(f"{kind}{i}") for kind, read in KINDS.items()]
    row = raw.agg(*counts).first()
    out = {}
    for i, n in enumerate(names):
        present = row[f"n{i}"]
        fits = [k for k in KINDS if present and present - row[f"{k}{i}"] <= tolerance * present]
        out[n] = fits[0] if fits else "string"
    return out
