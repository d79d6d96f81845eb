"""The test tables in their roles: people, waves, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.operators.segments import stacked
from cohortia.sources.tables import table

NOW = "timestamp_ntz '2001-09-01 00:00:00'"  # after the last order


def people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "persona").dropDuplicates(["id_persona"])


def demographics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "v_demografia").dropDuplicates(["id_persona"])


def attribute_values(spark: SparkSession, d: str) -> DataFrame:
    return stacked(demographics(spark, d), "id_persona", ["sexo", "localidad", "tramo_etario"], ["edad"])


def active(spark: SparkSession, d: str) -> DataFrame:
    """Distinct active members of panels."""
    return table(spark, d, "membresia", "panel_id", "id_persona", "estado").filter("estado = 'activo'").select("panel_id", "id_persona").distinct()


def population(spark: SparkSession, d: str) -> DataFrame:
    """Active members with demographics."""
    return active(spark, d).join(demographics(spark, d), "id_persona", "left")


def targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "objetivo_composicion").distinct().withColumnRenamed("proporcion_objetivo", "proporcion")


def participation(spark: SparkSession, d: str) -> DataFrame:
    """One fact per customer and year: the first order is the call; status F answered, P suspicious."""
    first = F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    facts = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    facts = facts.groupBy(F.col("o_custkey").alias("persona"), F.year("o_orderdate").alias("ola")).agg(F.min("o_orderdate").alias("convocado_en"), first.alias("estado"))
    quality = F.when(F.col("estado") == "P", "sospechoso").when(F.col("estado") == "O", "ok").otherwise("pendiente")
    return facts.withColumn("respondio", F.col("estado") == "F").withColumn("calidad", quality).drop("estado")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers with segment, nation and region."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("persona"), F.col("c_mktsegment").alias("segmento"), F.col("n_name").alias("pais"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("saldo"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers of people to surveys."""
    return table(spark, d, "documents", "doc_id", "text", "source", "id_persona", "encuesta_id", "creado_en")


# The same roles in SQL.
PART = """part as (select o_custkey as persona, year(o_orderdate)::int as ola, o_orderdate as convocado_en, o_orderstatus = 'F' as respondio,
  case o_orderstatus when 'P' then 'sospechoso' when 'O' then 'ok' else 'pendiente' end as calidad
  from orders qualify row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) = 1)"""
DEMO = "demo as (select distinct id_persona, sexo, localidad, edad, tramo_etario from v_demografia)"
ACTIVE = "act as (select distinct panel_id, id_persona from membresia where estado = 'activo')"
POP = f"{DEMO}, {ACTIVE}, pop as (select * from act left join demo using (id_persona))"
TARGETS = "obj as (select distinct panel_id, dimension, categoria, proporcion_objetivo as proporcion, n_muestra, minimo_categoria from objetivo_composicion)"
CUSTOMERS = """cust as (select c_custkey as persona, c_mktsegment as segmento, n_name as pais, r_name as region, c_acctbal as saldo from customer
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
SQL_NOW = "timestamp '2001-09-01 00:00:00'"
