"""Oracle SQL for the kNN family (brute force pairs; fine at oracle scale)."""

from __future__ import annotations

from .oracle_sql import NUMERIC, Chain


def _d2_sql(a: str, b: str, cols: list[str]) -> str:
    acc = " + ".join(f"coalesce(({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c}), 0)" for c in cols)
    present = " + ".join(f"CAST({a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL AS INTEGER)" for c in cols)
    return f"(({acc}) * {len(cols)}) / ({present})", f"({present})"


def add_knn_impute(ch: Chain, src: str, k: int = 7, key: str = "patient_id",
                   cols: list[str] = NUMERIC) -> str:
    d2, present = _d2_sql("a", "b", cols)
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    ch.add("kbase", f"SELECT {key}, {cast} FROM {src}")
    ch.add("kmiss", "\nUNION ALL\n".join(
        f"SELECT {key} AS r, '{c}' AS c FROM kbase WHERE {c} IS NULL" for c in cols))
    ch.add("kdon", "\nUNION ALL\n".join(
        f"SELECT {key} AS d, '{c}' AS c, {c} AS v FROM kbase WHERE {c} IS NOT NULL" for c in cols))
    ch.add("kpairs", f"""SELECT a.{key} AS r, b.{key} AS d, {d2} AS d2 FROM kbase a CROSS JOIN kbase b
  WHERE a.{key} IN (SELECT r FROM kmiss) AND a.{key} <> b.{key} AND {present} > 0""")
    ch.add("ktop", f"""SELECT * FROM (SELECT m.r, m.c, p.d, p.d2, dn.v,
  row_number() OVER (PARTITION BY m.r, m.c ORDER BY p.d2, p.d) AS rk
  FROM kmiss m JOIN kpairs p ON m.r = p.r JOIN kdon dn ON dn.d = p.d AND dn.c = m.c) WHERE rk <= {k}""")
    ch.add("kimp", """SELECT r, c, CASE WHEN count(*) FILTER (WHERE d2 = 0) > 0 THEN avg(v) FILTER (WHERE d2 = 0)
  ELSE sum(v * (1 / sqrt(d2))) / sum(1 / sqrt(d2)) END AS v FROM ktop GROUP BY r, c""")
    means = ", ".join(f"avg({c}) AS {c}" for c in cols)
    ch.add("kmean", f"SELECT {means} FROM kbase")
    sel = ", ".join(
        f"coalesce(b.{c}, (SELECT v FROM kimp WHERE kimp.r = b.{key} AND kimp.c = '{c}'), m.{c}) AS {c}"
        for c in cols)
    ch.add("kimputed", f"SELECT b.{key}, {sel} FROM kbase b CROSS JOIN kmean m")
    return "kimputed"
