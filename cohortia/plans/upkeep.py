"""Queries of upkeep: erasure, marks, first touches, consolidation, rounds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortia.operators import profiling, semantic, upkeep
from cohortia.plans import roles
from cohortia.plans.answers import CRITERIA, _judged_sql, evidence_units
from cohortia.sources.tables import table

Q, S = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


@query("""with g as (select distinct id_persona from inscripcion where estado = 'rechazada' and id_persona_previa is null and id_persona is not null union select distinct id_persona from membresia where estado = 'baja')
select doc_id, id_persona from documents where id_persona is null or id_persona not in (select id_persona from g)""")
def erased_answers(spark, d):
    gone = table(spark, d, "inscripcion", "id_persona", "estado", "id_persona_previa").filter("estado = 'rechazada' and id_persona_previa is null and id_persona is not null").select("id_persona")
    gone = gone.unionByName(table(spark, d, "membresia", "id_persona", "estado").filter("estado = 'baja'").select("id_persona")).distinct()
    return upkeep.erased({"documents": table(spark, d, "documents", "doc_id", "id_persona")}, gone, "id_persona")["documents"].select("doc_id", "id_persona")


@query("""with u as (select distinct sha256(text) as hash from documents where trim(text, ' ') <> '') select hash from u where hash not in (select sha256(text) from documents where trim(text, ' ') <> '' and source <> 'kiosco')""")
def orphan_units(spark, d):
    docs = table(spark, d, "documents", "text", "source").filter("trim(text) <> ''").withColumn("hash", F.sha2("text", 256))
    return upkeep.orphans(docs.select("hash").distinct(), docs.filter("source <> 'kiosco'"))


@query("""with p as (select distinct id_persona, localidad from persona) select id_persona, localidad, id_persona in (select id_persona from membresia where estado <> 'activo') as marcada from p""")
def suppression_marks(spark, d):
    listed = table(spark, d, "membresia", "id_persona", "estado").filter("estado <> 'activo'")
    return upkeep.marked(roles.people(spark, d).select("id_persona", "localidad"), listed, "id_persona", "marcada")


@query("select user_id, event_type, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from events group by all")
def first_touches(spark, d):
    return upkeep.first_touch(table(spark, d, "events", "user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")


@query("select user_id, array_to_string(list(event_id order by ts, event_id), ',') as envios from events where event_type = 'signup' group by 1")
def sends_per_person(spark, d):
    listed = upkeep.listed_sends(table(spark, d, "events", "user_id", "event_type", "ts", "event_id").filter("event_type = 'signup'"), "user_id", "ts", "event_id")
    return listed.select("user_id", F.array_join(F.transform("envios", lambda x: x["event_id"].cast("string")), ",").alias("envios"))


@query("""select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by case event_type when 'error' then 1 when 'purchase' then 2 when 'click' then 3 else 4 end, event_id) = 1""")
def verdict_by_priority(spark, d):
    rows = table(spark, d, "events", "user_id", "event_id", "event_type")
    return upkeep.by_priority(rows, ["user_id"], "event_type", ["error", "purchase", "click"], "event_id")


@query("""select user_id, round(sum(value), 2) as value, array_to_string(list_sort(list_distinct(list(event_type))), ',') as tipos, arg_min(props, event_id) as props from events group by 1""")
def batches_consolidated(spark, d):
    batches = table(spark, d, "events", "user_id", "event_id", "value", "event_type", "props").withColumn("tipos", F.array("event_type"))
    out = upkeep.consolidated(batches, "user_id", "event_id", ["value"], ["tipos"], ["props"])
    return out.withColumn("value", F.round("value", 2)).withColumn("tipos", F.array_join("tipos", ","))


@query("""select user_id, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase, round(sum(value), 4) as costo, datediff('second', min(ts), max(ts)) as segundos from
 (select user_id, event_type, value, date_trunc('second', ts) as ts from events) group by 1""")
def job_progress(spark, d):
    batches = table(spark, d, "events", "user_id", "event_type", "value", "ts").withColumn("ts", F.expr("ts - make_dt_interval(0, 0, 0, extract(second from ts) - floor(extract(second from ts)))"))
    return upkeep.progress(batches, "user_id", "event_type", "value", "ts", ["error", "purchase"])


@query("""with r as (select * from events where event_type <> 'error' order by ts desc, event_id desc limit 200) select count(*) as lotes, case when count(*) >= 3 then round(round(sum(value), 4) / count(distinct event_id), 6) end as por_unidad from r""")
def token_calibration(spark, d):
    ok = table(spark, d, "events", "event_id", "event_type", "value", "ts").filter("event_type <> 'error'").withColumn("u", F.lit(1))
    return upkeep.calibration(ok, F.desc(F.struct("ts", "event_id")), "value", "u")


@query("""with i as (select distinct id, id_persona_previa, documento, email, nombre, resolucion from inscripcion), p as (select documento, min(id_persona) as pd from persona where documento is not null group by 1),
 k as (select distinct id_persona from persona where coalesce(trim(nombre), '') <> 'Kiosco compartido'), r as (select lower(email) as mail, min(id_persona) as pr from inscripcion where email is not null and id_persona is not null group by 1)
select id, case when k.id_persona is not null then 'existente' when i.id_persona_previa is not null then 'id_desconocido' when coalesce(pr, pd) is not null then 'reconocido' when resolucion = 'revision' then 'revision' when nombre is not null then 'a_crear' else 'sin_datos' end as clase,
 coalesce(k.id_persona, pr, pd) as persona from i left join p using (documento) left join k on k.id_persona = i.id_persona_previa left join r on r.mail = lower(i.email)""")
def row_recognition(spark, d):
    """By the id given, by an earlier answer from the same mail, by document."""
    entries = table(spark, d, "inscripcion", "id", "id_persona_previa", "documento", "email", "nombre", "resolucion").dropDuplicates(["id"]).withColumn("mail", F.lower("email"))
    people = table(spark, d, "persona", "documento", "id_persona", "nombre")
    known = people.filter(F.coalesce(F.trim("nombre"), F.lit("")) != "Kiosco compartido").select(F.col("id_persona").alias("por_id")).distinct()
    papers = people.filter("documento is not null").groupBy("documento").agg(F.min("id_persona").alias("por_datos"))
    answered = table(spark, d, "inscripcion", "email", "id_persona").filter("email is not null and id_persona is not null").groupBy(F.lower("email").alias("mail")).agg(F.min("id_persona").alias("por_respuesta"))
    rows = entries.join(papers, "documento", "left").join(answered, "mail", "left").join(known, F.col("id_persona_previa") == F.col("por_id"), "left").select(
        "id", "por_id", F.col("id_persona_previa").isNotNull().alias("con_id"), "por_respuesta", "por_datos", (F.col("resolucion") == "revision").alias("dudoso"), F.col("nombre").isNotNull().alias("con_datos")
    )
    return upkeep.recognised(rows).select("id", "clase", "persona")


@query("""with p as (select distinct id_persona from persona) select id_persona, case when id_persona in (select id_persona from membresia) then 'membresias' when id_persona in (select id_persona_previa from inscripcion where id_persona_previa is not null) then 'inscripciones'
 when id_persona in (select id_persona from documents where id_persona is not null) then 'respuestas' end as impide from p""")
def deletion_classes(spark, d):
    blockers = {
        "membresias": table(spark, d, "membresia", "id_persona"),
        "inscripciones": table(spark, d, "inscripcion", "id_persona_previa").withColumnRenamed("id_persona_previa", "id_persona").filter("id_persona is not null"),
        "respuestas": table(spark, d, "documents", "id_persona").filter("id_persona is not null"),
    }
    return upkeep.deletable(roles.people(spark, d).select("id_persona"), blockers, "id_persona")


@query("""select atributo_id, array_to_string(list_sort(list(clave) filter (not activo)), ',') as sin_mapa from atributo_categoria group by 1""")
def unmapped_options(spark, d):
    categories = table(spark, d, "atributo_categoria", "atributo_id", "clave", "etiqueta", "activo")
    pair = F.struct("clave", "etiqueta")
    questions = categories.groupBy("atributo_id").agg(F.map_from_entries(F.collect_list(pair)).alias("opciones"), F.map_from_entries(F.collect_list(F.when(F.col("activo"), pair))).alias("mapa"))
    lacking = upkeep.unmapped_options(questions, "opciones", "mapa").select("atributo_id", "sin_mapa")
    return lacking.select("atributo_id", F.when(F.size("sin_mapa") > 0, F.array_join("sin_mapa", ",")).alias("sin_mapa"))


@query(f"""with {_judged_sql(CRITERIA)}, k as (select hash, veredicto, row_number() over (order by relevancia desc, hash)::int as rango from j where criterio = 0),
 b as (select *, coalesce(sum(case when veredicto <> 'irrelevante' then 1 else 0 end) over (order by rango rows between unbounded preceding and 1 preceding), 0) as antes from k where rango <= 75) select hash, rango, veredicto from b where antes < 25""")
def verification_rounds(spark, d):
    judged = semantic.judged(evidence_units(spark, d), CRITERIA[:1], "texto").select("hash", "veredicto", "relevancia")
    top = judged.orderBy(F.desc("relevancia"), "hash").limit(75)
    ranked = top.withColumn("rango", F.row_number().over(Window.orderBy(F.desc("relevancia"), "hash"))).withColumn("pertinente", F.col("veredicto") != "irrelevante")
    return upkeep.rounds(ranked, 25).select("hash", "rango", "veredicto")


@query("""with q as (select distinct clave as codigo from atributo_auditoria where clave is not null), r as (select regexp_replace(codigo, '[_.]?[0-9]+$', '') as raiz, codigo from q)
select raiz, count(*) as preguntas, array_to_string(list_sort(list(codigo)), ',') as codigos from r where raiz <> codigo group by 1 having count(*) >= 3""")
def code_batteries(spark, d):
    return profiling.batteries(table(spark, d, "atributo_auditoria", "clave").filter("clave is not null").distinct().withColumnRenamed("clave", "codigo"))


QUERIES, SQL = Q, S
