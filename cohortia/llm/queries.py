"""Queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortia.llm import canonical, mixing, quotas, splitting, tokens, variants
from cohortia.session import spread
from cohortia.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = quotas.unmet(table(spark, d, "membresia"), table(spark, d, "v_demografia"), table(spark, d, "objetivo_composicion"))
    return found.select("panel_id", "dimension", "categoria")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return quotas.sample(table(spark, d, "membresia"), table(spark, d, "v_demografia"), table(spark, d, "objetivo_composicion"))[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return quotas.sample(table(spark, d, "membresia"), table(spark, d, "v_demografia"), table(spark, d, "objetivo_composicion"))[1]


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per sampled panel: persons drawn, whether all are active members drawn once, and whether the report counts them rightly."""
    membership, people, goals = table(spark, d, "membresia"), table(spark, d, "v_demografia"), table(spark, d, "objetivo_composicion")
    drawn, report = quotas.sample(membership, people, goals)
    active = membership.filter("estado = 'activo'").select("panel_id", "id_persona").distinct().withColumn("activa", F.lit(True))
    by_panel = drawn.join(active, ["panel_id", "id_persona"], "left").groupBy("panel_id").agg(F.count(F.lit(1)).alias("personas"), F.count_if("activa").alias("activas"), F.count_distinct("id_persona").alias("distintas"))
    told = report.groupBy("panel_id", "dimension").agg(F.sum("asignados").alias("n")).groupBy("panel_id").agg(F.max("n").alias("informadas"))
    minima = report.groupBy("panel_id").agg(F.bool_and((F.col("asignados") >= F.least("minimo_categoria", "disponibles")) | (F.col("causa") == "otras_dimensiones")).alias("minimos"))
    both = by_panel.join(told, "panel_id").join(minima, "panel_id")
    return both.select("panel_id", "personas", ((F.col("activas") == F.col("personas")) & (F.col("distintas") == F.col("personas")) & (F.col("informadas") <= F.col("personas"))).alias("validas"), "minimos")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    columns = ("nombre", "fecha_nacimiento", "celular", "email", "documento")
    people = table(spark, d, "persona", "id_persona", *columns)
    registrations = table(spark, d, "inscripcion", "id", "id_persona", "id_persona_previa", *columns)
    return variants.links(variants.panel_records(people, registrations, table(spark, d, "alta_en_revision", "id", "datos", "candidatos", "estado")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.pairs_of(_groups(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each linked record with the key of its group and the number of its links."""
    groups = _groups(spark, d)
    sizes = groups.groupBy("persona").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("persona").startswith("p"), 0).otherwise(-1)
    return groups.join(sizes, "persona").select("clave", "persona", (F.col("n") + own).alias("enlaces"))


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Whether each record is in one group, persons head groups and join none, and every group's head exists."""
    groups = _groups(spark, d)
    persons = table(spark, d, "persona", F.concat(F.lit("p"), "id_persona").alias("persona")).distinct()
    heads = groups.filter("persona like 'p%'").select("persona").distinct().join(persons, "persona", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    own = groups.agg((F.count(F.lit(1)) == F.count_distinct("clave")).alias("una_vez"), (F.count_if(F.col("clave").startswith("p")) == 0).alias("personas_aparte"))
    return own.select("una_vez", "personas_aparte", (heads.select("n").scalar() == 0).alias("existen"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "persona_atributo", "id", "atributo_id", "categoria_id", "valor_crudo")
    return canonical.map_values(rows, table(spark, d, "atributo_categoria"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select(F.col("id").alias("persona_atributo_id"), "categoria_id")


def p5_misses(spark: SparkSession, d: str) -> DataFrame:
    return canonical.misses(_mapped(spark, d))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Typed values looked up, by attribute."""
    return _mapped(spark, d).groupBy("atributo_id").agg(F.count(F.lit(1)).alias("casos"), F.count_distinct("id").alias("filas"))


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text", *columns), "doc_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(_texts(spark, d))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text, decoded from the ids."""
    return tokens.decode_ids(tokens.encode_texts(_texts(spark, d)))


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_texts(_texts(spark, d), byte_ends="byte_fin")


def p6_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of each text by the end of its last token."""
    ends = tokens.encode_texts(_texts(spark, d), byte_ends="byte_fin")
    return ends.select("doc_id", F.coalesce(F.try_element_at("byte_fin", F.lit(-1)), F.lit(0)).cast("bigint").alias("bytes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the mix has all repetitions, and less than their target."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mezcla_objetivo"))[1].filter("agotada").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mezcla_objetivo"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mezcla_objetivo"))[1]


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source stays within the bound of its share at any time, ends within a document of its target, and is repeated no more than allowed."""
    mixed, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mezcla_objetivo"))
    copies = mixed.groupBy("source").agg((F.max("repeticion") + 1).alias("veces"), F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id", "repeticion").alias("distintos"))
    near = F.abs(F.col("mezclado") - F.col("asignado")) <= F.col("mayor")
    return report.join(copies, "source", "left").select(
        "source", (F.col("desviacion") <= F.col("cota")).alias("cerca_siempre"), near.alias("cerca_al_final"), (F.coalesce("veces", F.lit(0)) <= F.col("tope_repeticiones")).alias("repeticiones"), F.coalesce(F.col("n") == F.col("distintos"), F.lit(True)).alias("sin_duplicados")
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    cut = splitting.split_texts(_texts(spark, d), only_long=True)
    return cut.filter((F.col("pieza") == 0) & (F.col("tokens_texto") > splitting.LIMIT)).select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(_texts(spark, d), only_long=True)


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and text put together from its pieces without what overlaps, and whether all are within the limit."""
    cut = splitting.split_texts(_texts(spark, d))
    before = F.lag("char_fin").over(Window.partitionBy("doc_id").orderBy("pieza"))
    own = cut.withColumn("propio", F.substring(F.col("texto"), F.coalesce(before - F.col("char_ini"), F.lit(0)) + 1, F.length("texto")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pieza", "propio"))), lambda x: x["propio"]), "")
    return own.groupBy("doc_id").agg(joined.alias("text"), F.bool_and(F.col("n_tokens") <= splitting.LIMIT).alias("dentro"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sample, p1_report, p1_invariants, p3_found, p3_groups, p3_invariants, p5_found, p5_misses, p5_counts, p6_ids, p6_round_trip, p6_spans, p6_lengths, p7_found, p7_mix, p7_shares, p7_invariants, p8_found, p8_pieces, p8_round_trip)}

SQL = {
    "p1_found": """
with o as (select distinct * from objetivo_composicion),
 m as (select distinct panel_id, id_persona from membresia where estado = 'activo'),
 v as (select distinct id_persona, sexo, tramo_etario, localidad from v_demografia),
 x as (select panel_id, 'sexo' as dimension, sexo as categoria, id_persona from m join v using (id_persona)
  union all select panel_id, 'tramo_etario', tramo_etario, id_persona from m join v using (id_persona)
  union all select panel_id, 'localidad', localidad, id_persona from m join v using (id_persona)),
 n as (select panel_id, dimension, categoria, count(distinct id_persona) as n from x group by all)
select panel_id, dimension, categoria from o left join n using (panel_id, dimension, categoria)
where coalesce(n, 0) < greatest(proporcion_objetivo * n_muestra, minimo_categoria)""",
    "p1_invariants": """
with o as (select panel_id, max(coalesce(n_muestra, 0)) as n from objetivo_composicion where panel_id is not null group by 1),
 m as (select panel_id, count(distinct id_persona) as hay from membresia where estado = 'activo' and id_persona is not null group by 1)
select panel_id, least(n, hay) as personas, true as validas, true as minimos from o join m using (panel_id) where least(n, hay) > 0""",
    "p7_invariants": "select distinct source, true as cerca_siempre, true as cerca_al_final, true as repeticiones, true as sin_duplicados from mezcla_objetivo",
    "p3_invariants": "select true as una_vez, true as personas_aparte, true as existen",
    "p5_counts": "select atributo_id, count(distinct id) as casos, count(distinct id) as filas from persona_atributo where categoria_id is null and valor_crudo is not null group by 1",
    "p6_lengths": "select doc_id, coalesce(strlen(text), 0) as bytes from documents",
    "p8_round_trip": "select doc_id, text, true as dentro from documents where text <> ''",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
