"""Reshaping and loading of wide files: cells to answers, texts, counts, canonical categories, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.expressions import fold
from cohortia.operators.quality import latest_kept

# Answers that stand for none, folded; the codes count only in questions with labels.
NO_ANSWER = [
    "no sabe", "no contesta", "no aplica", "no responde", "ns", "nc", "ns/nc", "no sabe / no contesta", "no sabe/no contesta",
    "prefiero no responder", "prefiere no responder", "sin dato", "don't know", "refused", "n/a",
]
NO_ANSWER_CODES = ["98", "99"]


def unpivoted(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys..., codigo, valor): one row per cell, values as text; whole numbers without decimals."""
    kinds = dict(wide.dtypes)

    def text(c: str) -> Column:
        if kinds[c] in ("double", "float"):
            whole = F.col(c) == F.floor(c)
            return F.when(F.isnan(c), None).when(whole, F.col(c).cast("bigint").cast("string")).otherwise(F.col(c).cast("string"))
        return F.col(c).cast("string")

    return wide.select(*keys, *(text(c).alias(c) for c in columns)).unpivot(keys, columns, "codigo", "valor")


def answer_texts(cells: DataFrame, questions: DataFrame, excluded: list[str] = NO_ANSWER) -> DataFrame:
    """cells with etiqueta, texto `question → label`, hash, and motivo of the cells that give no answer: vacia, no_respuesta.

    questions: codigo, pregunta, opciones (map of code to label); joined by broadcast, as a file has few questions.
    """
    joined = cells.join(F.broadcast(questions), "codigo", "left")
    value = F.trim("valor")
    label = F.coalesce(F.try_element_at("opciones", value), value)
    unlabelled = value.isin(NO_ANSWER_CODES) & (F.size("opciones") > 0) & F.try_element_at("opciones", value).isNull()
    reason = F.when(value.isNull() | (value == ""), "vacia").when(fold(label).isin(excluded) | fold(value).isin(excluded) | unlabelled, "no_respuesta")
    out = joined.withColumn("motivo", reason).withColumn("etiqueta", F.when(F.col("motivo").isNull(), label))
    text = F.concat(F.trim(F.coalesce("pregunta", "codigo")), F.lit(" → "), F.trim("etiqueta"))
    return out.withColumn("texto", text).withColumn("hash", F.sha2("texto", 256)).drop("opciones", "pregunta")


def distributions(cells: DataFrame) -> DataFrame:
    """(codigo, valor, n) of the values that aren't blank."""
    return cells.filter(F.trim("valor") != "").groupBy("codigo", "valor").agg(F.count(F.lit(1)).alias("n"))


def last_answers(cells: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return latest_kept(cells, keys, order)


def new_units(answers: DataFrame, units: DataFrame) -> DataFrame:
    """(hash, texto) of the distinct texts that have no unit yet: the only ones that need a vector."""
    return answers.filter("hash is not null").groupBy("hash").agg(F.min("texto").alias("texto")).join(units.select("hash"), "hash", "left_anti")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table after an upsert: rows of new replace those of old with the same key. Both have the same columns; new has a row per key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def completed(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """old with its missing fields filled from new, and the discrepancies (key, campo, antes, archivo) that were not applied."""
    joined = old.join(new.select(key, *(F.col(f).alias(f"__{f}") for f in fields)), key, "left")
    filled = joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in old.columns))
    entries = F.array(*(F.struct(F.lit(f).alias("campo"), F.col(f).cast("string").alias("antes"), F.col(f"__{f}").cast("string").alias("archivo")) for f in fields))
    differ = joined.select(key, F.explode(entries).alias("x")).select(key, "x.*").filter("antes <> archivo")
    return filled, differ


def canonical(values: DataFrame, categories: DataFrame, raw: str, attribute: str) -> DataFrame:
    """values with categoria_id: exact key, else key without case or accents, else label without case or accents; the lowest id on ties.

    categories: id, attribute, clave, etiqueta; a reference list, so three small maps are joined.
    """

    def by(column: Column, name: str) -> DataFrame:
        return F.broadcast(categories.select(attribute, column.alias("__k"), F.col("id")).groupBy(attribute, "__k").agg(F.min("id").alias(name)))

    out = values
    for column, key, name in ((F.col("clave"), F.trim(raw), "__a"), (fold(F.col("clave")), fold(F.col(raw)), "__b"), (fold(F.col("etiqueta")), fold(F.col(raw)), "__c")):
        out = out.withColumn("__k", key).join(by(column, name), [attribute, "__k"], "left").drop("__k")
    return out.withColumn("categoria_id", F.coalesce("__a", "__b", "__c")).drop("__a", "__b", "__c")


def reprocessed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., accion) of a reprocessing: conserva where the hash stays, reembebe where it differs or is new, borra where none is left."""
    joined = old.select(*keys, F.col("hash").alias("__a")).join(new.select(*keys, F.col("hash").alias("__b")), keys, "full")
    action = F.when(F.col("__b").isNull(), "borra").when(F.col("__a") == F.col("__b"), "conserva").otherwise("reembebe")
    return joined.select(*keys, action.alias("accion"))


def variable_profile(cells: DataFrame, rows: int | None = None) -> DataFrame:
    """(codigo, con_dato, distintos, identificador): filled cells and values of each variable; an identifier is filled and unique in all rows."""
    filled = F.trim("valor") != ""
    out = cells.groupBy("codigo").agg(F.count(F.lit(1)).alias("filas"), F.count_if(filled).alias("con_dato"), F.count_distinct(F.when(filled, F.col("valor"))).alias("distintos"))
    return out.withColumn("identificador", (F.col("con_dato") == F.col("filas")) & (F.col("distintos") == F.col("filas")))


def _reason(value: Column) -> Column:
    return F.when(value.isNull() | (F.trim(value) == ""), "vacia").when(fold(value).isin(NO_ANSWER), "no_respuesta")


def cell_counters(cells: DataFrame) -> DataFrame:
    """(codigo, celdas, vacias, no_respuesta, respuestas) of the cells (codigo, valor)."""
    reason = _reason(F.col("valor"))
    return cells.groupBy("codigo").agg(F.count(F.lit(1)).alias("celdas"), F.count_if(reason == "vacia").alias("vacias"), F.count_if(reason == "no_respuesta").alias("no_respuesta"), F.count_if(reason.isNull()).alias("respuestas"))


def ingested(wide: DataFrame, key: str, columns: list[str], identifier: str, people: DataFrame, permitted: Column) -> DataFrame:
    """Every cell of a wide file with its person, unit and `destino`: vacia, no_respuesta, sin_persona, sin_permiso, or cargada.

    people: identifier, id_persona; an identifier of several persons identifies none. permitted: a condition on the rows, null is no. A cell that is
    loaded has the text `codigo → valor` and its hash, under which its unit is stored once. Rows are joined before they are unpivoted.
    """
    known = people.filter(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.min("id_persona").alias("__x"), F.max("id_persona").alias("__y"))
    known = known.select(F.col(identifier).alias("__clave"), F.when(F.col("__x") == F.col("__y"), F.col("__x")).alias("persona"))
    rows = wide.withColumn("__permiso", F.coalesce(permitted, F.lit(False))).withColumn("__clave", F.col(identifier)).join(known, "__clave", "left")
    cells = unpivoted(rows, [key, "persona", "__permiso"], columns)
    target = F.coalesce(_reason(F.col("valor")), F.when(F.col("persona").isNull(), "sin_persona").when(~F.col("__permiso"), "sin_permiso").otherwise("cargada"))
    text = F.when(F.col("destino") == "cargada", F.concat(F.col("codigo"), F.lit(" → "), F.trim("valor")))
    return cells.withColumn("destino", target).drop("__permiso").withColumn("texto", text).withColumn("hash", F.sha2("texto", 256))


def summary(cells: DataFrame, key: str) -> DataFrame:
    """(destino, celdas, filas, personas, unidades) of ingested cells."""
    return cells.groupBy("destino").agg(F.count(F.lit(1)).alias("celdas"), F.count_distinct(key).alias("filas"), F.count_distinct("persona").alias("personas"), F.count_distinct("hash").alias("unidades"))
