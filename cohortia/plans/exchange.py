"""Queries of sources, sinks and streams: files are written to the shared folder and read again by the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.operators import semantic
from cohortia.plans import answers, roles
from cohortia.plans.answers import CRITERIA, _judged_sql
from cohortia.session import shared_file
from cohortia.sources import files
from cohortia.sources.spss import Variable, write_sav
from cohortia.sources.tables import table
from cohortia.streaming import inbox

Q, S = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


@query("select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer")
def csv_round_trip(spark, d):
    path = shared_file(spark, "csv")
    files.write_csv(table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment"), path)
    return files.wide_csv(spark, path)


@query("select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as s_nationkey from supplier")
def sav_round_trip(spark, d):
    """An SPSS file is one stream, written by the driver from rows that pass it one partition at a time."""
    path = shared_file(spark, "sav").removeprefix("file://") + ".sav"
    rows = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey").toLocalIterator()
    write_sav(path, [Variable("s_suppkey", 0, "Clave"), Variable("s_name", 40, "Nombre"), Variable("s_nationkey", 0, "País")], (tuple(r) for r in rows))
    files.register(spark)
    return spark.read.format("sav_wide").load(path=path)


_IDENTIFIED = "r as (select id_persona, count(*) as puntaje from documents where id_persona is not null group by 1), p as (select distinct on (id_persona) * from persona)"


@query(f"with {_IDENTIFIED} select id_persona, nombre, documento, email, celular, localidad, puntaje from r left join p using (id_persona)")
def identified_ranking(spark, d):
    ranking = table(spark, d, "documents", "id_persona").filter("id_persona is not null").groupBy("id_persona").agg(F.count(F.lit(1)).alias("puntaje"))
    return files.identified(roles.people(spark, d), ranking)


@query("""with e as (select user_id, max(case when event_type = 'click' then 1 else 0 end) as tipo_1, max(case when event_type = 'purchase' then 1 else 0 end) as tipo_2, max(case when event_type = 'view' then 1 else 0 end) as tipo_3,
 max(case when event_id % 3 = 0 and event_type = 'error' then 1 when event_id % 3 = 0 and event_type = 'signup' then 2 end) as cerrada from events group by 1) select user_id, tipo_1, tipo_2, tipo_3, cerrada from e""")
def options_as_columns(spark, d):
    events = table(spark, d, "events", "user_id", "event_id", "event_type")
    chosen = events.select("user_id", F.lit("tipo").alias("codigo"), F.col("event_type").alias("valor")).unionByName(events.filter("event_id % 3 = 0").select("user_id", F.lit("cerrada").alias("codigo"), F.col("event_type").alias("valor")))
    return files.options_to_columns(chosen, "user_id", "codigo", "valor", {"tipo": ["click", "purchase", "view"], "cerrada": ["error", "signup"]}, {"tipo"})


def _inbox(spark, d) -> str:
    """The events as notices, read by the stream until none is left; every tenth is no JSON. The folder of the table."""
    folder = shared_file(spark, "bandeja")
    events = table(spark, d, "events", "event_id", "user_id", "event_type", "ts")
    body = F.to_json(F.struct(F.concat(F.lit("m"), "user_id").alias("mensaje"), F.col("event_type").alias("estado"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("en")))
    bad = F.concat(F.lit("aviso "), "event_id")
    events.select(F.when(F.col("event_id") % 10 == 0, bad).otherwise(body).alias("cuerpo"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("recibido_en")).write.json(f"{folder}/in")
    inbox.run_inbox(spark, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint", late="60 days").awaitTermination()
    return f"{folder}/table"


_NOTICES = "n as (select 'm' || user_id as mensaje, event_type as estado, strftime(ts, '%Y-%m-%d %H:%M:%S') as en from events where event_id % 10 <> 0)"


@query(f"with {_NOTICES} select mensaje, estado, max(en) as en from n group by all")
def inbox_statuses(spark, d):
    return inbox.current_statuses(spark, _inbox(spark, d)).select("mensaje", "estado", F.date_format("en", "yyyy-MM-dd HH:mm:ss").alias("en"))


@query("select 'aviso ' || event_id as cuerpo, 'fallido' as estado_aviso from events where event_id % 10 = 0")
def inbox_failures(spark, d):
    return inbox.reprocessed(inbox.failed_notices(spark, _inbox(spark, d))).select("cuerpo", "estado_aviso")


@query("""with x as (select user_id as persona, ts::date as hasta, count(*) as n from events group by all)
select persona, hasta, sum(n) over (partition by persona order by hasta range between interval 6 days preceding and current row)::bigint as llamados from x""")
def calls_in_last_days(spark, d):
    stream = table(spark, d, "events", F.col("user_id").alias("persona"), F.col("ts").cast("timestamp").alias("en"))
    return inbox.calls_in_window(inbox.calls_by_day(stream), 7)


@query(f"with {_judged_sql(CRITERIA[:1])} select hash, -relevancia as clave_orden from j where criterio = 0")
def reranked_units(spark, d):
    pool = semantic.judged(answers.evidence_units(spark, d).select("texto"), CRITERIA[:1], "texto").withColumn("distancia", F.lit(0.5))
    return semantic.reranked(pool).select("hash", "clave_orden")


QUERIES, SQL = Q, S
