"""Segments of people: attributes valid at a time, conditions on them and on participation, seeded draws.

Conditions are semi and anti joins by person, so that a person stays one row and no identifiers are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.criteria import Criterion
from cohortia.functions.expressions import age_band, completed_years, fold


def valid_at(rows: DataFrame, at: Column, desde: str = "desde", hasta: str = "hasta") -> DataFrame:
    """Rows valid at a time: null beginning is always, null end is not yet."""
    return rows.filter((F.col(desde).isNull() | (F.col(desde) <= at)) & (F.col(hasta).isNull() | (at < F.col(hasta))))


def attribute_values(rows: DataFrame, categories: DataFrame, at: Column) -> DataFrame:
    """(id_persona, atributo_id, valor, valor_num) at a time: the latest written row that is valid, with the category's key or the
    number or date as text. Persons without a value have no row."""
    keys = categories.select(F.col("id").alias("categoria_id"), "clave").dropDuplicates(["categoria_id"])
    held = rows.filter(F.coalesce(F.col("categoria_id").cast("string"), F.col("valor_num").cast("string"), F.col("valor_fecha").cast("string")).isNotNull())
    latest = F.max_by(F.struct("categoria_id", "valor_num", "valor_fecha"), F.struct("desde", "actualizado_en", "id")).alias("x")
    now = valid_at(held, at).groupBy("id_persona", "atributo_id").agg(latest).select("id_persona", "atributo_id", "x.*")
    value = F.coalesce("clave", F.col("valor_num").cast("decimal(20,2)").cast("string"), F.col("valor_fecha").cast("string"))
    return now.join(F.broadcast(keys), "categoria_id", "left").select("id_persona", "atributo_id", value.alias("valor"), "valor_num")


def derived_age(people: DataFrame, at: Column, born: str = "fecha_nacimiento") -> DataFrame:
    """(id_persona, edad, tramo_etario) by completed years at a time."""
    aged = people.filter(F.col(born).isNotNull()).select("id_persona", completed_years(F.col(born), at).alias("edad"))
    return aged.withColumn("tramo_etario", age_band(F.col("edad")))


def stacked(wide: DataFrame, key: str, texts: list[str], numbers: list[str]) -> DataFrame:
    """Attribute values (key, atributo, valor, valor_num) of the non-null columns of a wide table."""
    entries = [F.struct(F.lit(c).alias("atributo"), F.col(c).cast("string").alias("valor"), F.lit(None).cast("double").alias("valor_num")) for c in texts]
    entries += [F.struct(F.lit(c).alias("atributo"), F.col(c).cast("string").alias("valor"), F.col(c).cast("double").alias("valor_num")) for c in numbers]
    return wide.select(key, F.explode(F.array(*entries)).alias("x")).select(key, "x.*").filter("valor is not null")


def condition(c: Criterion) -> Column:
    """The criterion on columns valor, valor_num."""
    number = isinstance(c.value, float)
    column = F.col("valor_num") if number else F.col("valor")
    if c.operator in ("in", "not_in"):
        found = column.isin(*c.values)
        return found if c.operator == "in" else ~found
    if c.operator == "contiene":
        return column.ilike(f"%{c.value}%")
    return {"eq": column == c.value, "ne": column != c.value, "lt": column < c.value, "lte": column <= c.value, "gt": column > c.value, "gte": column >= c.value}[c.operator]


def matching(people: DataFrame, values: DataFrame, criteria: list[Criterion], key: str = "id_persona") -> DataFrame:
    """People with a value that meets each criterion. Who has no value of an attribute meets neither its positive nor negative criteria."""
    for c in criteria:
        met = values.filter((F.col("atributo") == c.dimension) & condition(c)).select(key)
        people = people.join(met, key, "left_semi")
    return people


def related(people: DataFrame, facts: DataFrame, key: str, has: bool = True) -> DataFrame:
    """People with (has) or without a row among the facts."""
    return people.join(facts.select(key), key, "left_semi" if has else "left_anti")


def with_history(people: DataFrame, facts: DataFrame, key: str, times: int, at_least: bool = True) -> DataFrame:
    """People with at least, or fewer than, so many facts; facts hold only those of the period asked for."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    n = F.coalesce("__n", F.lit(0))
    return people.join(counts, key, "left").filter(n >= times if at_least else n < times).drop("__n")


def drawn(df: DataFrame, key: str, seed: str, limit: int, offset: int = 0) -> DataFrame:
    """The rows at places offset + 1 to offset + limit of a reproducible random order, with their place."""
    order = [F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), F.col(key)]
    page = df.orderBy(*order).offset(offset).limit(limit)


    return page.withColumn("lugar", offset + F.row_number().over(Window.orderBy(*order)))


def named_like(people: DataFrame, aliases: DataFrame, text: str, columns: list[str], key: str = "id_persona") -> DataFrame:
    """People one of whose columns contains the text, or one of whose aliases (key, alias) does, whatever the case and accents."""
    wanted = fold(F.lit(text))
    known = aliases.filter(fold(F.col("alias")).contains(wanted)).select(key).distinct().withColumn("__alias", F.lit(True))
    found = F.coalesce("__alias", F.lit(False))
    for c in columns:
        found = found | F.coalesce(fold(F.col(c)).contains(wanted), F.lit(False))
    return people.join(known, key, "left").filter(found).drop("__alias")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, null if none does."""
    out = F.when(reasons[0][1], reasons[0][0])
    for name, holds in reasons[1:]:
        out = out.when(holds, name)
    return out


def aged(people: DataFrame, rows: DataFrame, categories: DataFrame, at: Column, declared: int, band: int, born: str = "fecha_nacimiento") -> DataFrame:
    """(id_persona, edad, procedencia, tramo_etario) at a time: completed years since birth (derivado), else the declared age and the completed years since
    its reference date (envejecido; none without a date or before it), else the stored band alone (tramo_guardado). Who has none of these has no row.

    declared, band: the attributes of the declared age (a number) and of the band (a category).
    """
    held = valid_at(rows.filter(F.col("atributo_id").isin(declared, band) & F.coalesce(F.col("categoria_id").cast("string"), F.col("valor_num").cast("string"), F.col("valor_fecha").cast("string")).isNotNull()), at)
    latest = F.max_by(F.struct("categoria_id", "valor_num", "fecha_referencia"), F.struct("desde", "actualizado_en", "id")).alias("x")
    now = held.groupBy("id_persona", "atributo_id").agg(latest)
    both = now.groupBy("id_persona").agg(F.max(F.when(F.col("atributo_id") == declared, F.struct("x.valor_num", "x.fecha_referencia"))).alias("e"), F.max(F.when(F.col("atributo_id") == band, F.col("x.categoria_id"))).alias("categoria_id"))
    names = categories.filter(F.col("atributo_id") == band).select(F.col("id").alias("categoria_id"), F.col("clave").alias("guardado")).distinct()
    known = people.select("id_persona", F.col(born).alias("nacio")).join(both.join(names, "categoria_id", "left"), "id_persona", "left")
    since = F.coalesce(F.greatest(F.lit(0), completed_years(F.col("e.fecha_referencia"), at)), F.lit(0))
    age = F.when(F.col("nacio").isNotNull(), completed_years(F.col("nacio"), at)).otherwise(F.floor("e.valor_num").cast("int") + since)
    source = F.when(F.col("nacio").isNotNull(), "derivado").when(F.col("e.valor_num").isNotNull(), "envejecido").when(F.col("guardado").isNotNull(), "tramo_guardado")
    out = known.select("id_persona", age.cast("int").alias("edad"), source.alias("procedencia"), "guardado").filter("procedencia is not null")
    return out.withColumn("tramo_etario", F.coalesce(age_band(F.col("edad")), "guardado")).drop("guardado")
