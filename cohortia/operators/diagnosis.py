"""Diagnosis of a whole file: findings by variable, the gravest first.

Everything comes from the distribution of values (one aggregation of the cells); the findings are its rows and aggregates, so a file of any
length costs one pass. Severities: 1 must be mended, 2 should be looked at, 3 is worth knowing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.expressions import fold
from cohortia.operators.ingest import NO_ANSWER
from cohortia.operators.profiling import PATTERNS, personal_data

SEVERITY = {
    "datos_personales": 1, "codificacion": 1, "variable_vacia": 2, "no_respuesta": 2, "casi_constante": 3, "espacios": 3, "formas_de_un_valor": 3, "mayormente_vacia": 3,
}


def diagnosed(cells: DataFrame, rows: int, kinds: tuple[str, ...] = tuple(k for k, _ in PATTERNS), share: float = 0.95, least: int = 20) -> DataFrame:
    """(codigo, tipo, severidad, cuantos, orden) of a file's cells (codigo, valor). rows: rows of the file; kinds: personal data to look for.

    variable_vacia: no answer at all; mayormente_vacia: in less than half of the rows; casi_constante: one value has the share of at least `least`
    answers; no_respuesta: answers that stand for none; espacios: outer blanks; codificacion: text decoded wrongly; formas_de_un_valor: values that differ
    in case and accents only; datos_personales: values that hold such. Null and blank cells are no answers; an empty file has no findings.
    """
    filled = F.trim("valor") != ""
    values = cells.groupBy("codigo", F.when(filled, F.col("valor")).alias("valor")).agg(F.count(F.lit(1)).alias("n"))
    given = F.col("valor").isNotNull()
    found = F.size(F.filter("hallazgos", lambda x: x["tipo"].isin(*kinds))) > 0
    read = personal_data(values, "valor").withColumn("plegado", F.when(given, fold(F.col("valor"))))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    each = read.groupBy("codigo").agg(
        total(given).alias("respuestas"),
        F.coalesce(F.max(F.when(given, F.col("n"))), F.lit(0)).alias("mayor"),
        total(F.col("plegado").isin(NO_ANSWER)).alias("no_respuesta"),
        total(F.col("valor") != F.trim("valor")).alias("espacios"),
        total(found).alias("personales"),
        total(F.col("valor").rlike("[ÃÂ][\\u0080-\\u00bf]")).alias("rotos"),
        (F.count_if(given) - F.count_distinct("plegado")).alias("formas"),
    )
    answered = F.col("respuestas")
    cases = [
        ("variable_vacia", answered == 0, F.lit(rows)),
        ("mayormente_vacia", (answered > 0) & (answered < 0.5 * rows), rows - answered),
        ("casi_constante", (answered >= least) & (F.col("mayor") >= share * answered), F.col("mayor")),
        ("no_respuesta", F.col("no_respuesta") > 0, F.col("no_respuesta")),
        ("datos_personales", F.col("personales") > 0, F.col("personales")),
        ("espacios", F.col("espacios") > 0, F.col("espacios")),
        ("codificacion", F.col("rotos") > 0, F.col("rotos")),
        ("formas_de_un_valor", F.col("formas") > 0, F.col("formas")),
    ]
    findings = [F.when(holds, F.struct(F.lit(kind).alias("tipo"), F.lit(SEVERITY[kind]).alias("severidad"), n.cast("bigint").alias("cuantos"))) for kind, holds, n in cases]
    out = each.select("codigo", F.explode(F.array_compact(F.array(*findings))).alias("x")).select("codigo", "x.*")
    order = Window.orderBy("severidad", F.desc("cuantos"), "codigo", "tipo")  # a few rows per variable
    return out.withColumn("orden", F.row_number().over(order))


def middle(distribution: DataFrame, most: int = 3) -> DataFrame:
    """(codigo, valor, n, lugar) of the values in the middle of each variable's order by frequency, where it has three times as many."""
    by = Window.partitionBy("codigo")
    placed = distribution.withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "valor"))).withColumn("m", F.count(F.lit(1)).over(by))
    at = F.floor((F.col("m") - most) / 2)
    return placed.filter(F.col("m") >= 3 * most).withColumn("lugar", (F.col("k") - at).cast("int")).filter(F.col("lugar").between(1, most)).select("codigo", "valor", "n", "lugar")
