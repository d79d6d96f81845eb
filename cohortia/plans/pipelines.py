"""Queries of whole pipelines and of what spans several operators: ingestion, diagnosis of files, exhaustive semantic queries, topics, ages."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortia.operators import ann, diagnosis, identity, ingest, segments, semantic, topics
from cohortia.plans import answers, panel, roles
from cohortia.plans.answers import CRITERIA, _judged_sql, _query_vector
from cohortia.sources.tables import table

Q, S = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


# --- ingestion and diagnosis of files -----------------------------------------------------------------------------

_WIDE = ["nombre", "documento", "localidad", "sexo", "motivo_rechazo"]
_NO = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ingest.NO_ANSWER) + "]"
_CELLS = "i as (select distinct id, nombre, documento, localidad, sexo, motivo_rechazo, finalidades from inscripcion), c as (" + " union all ".join(f"select id, documento, finalidades, '{c}' as codigo, {c} as valor from i" for c in _WIDE) + f"""),
 m as (select *, case when valor is null or trim(valor, ' ') = '' then 'vacia' when list_contains({_NO}, trim(strip_accents(lower(valor)), ' ')) then 'no_respuesta' end as motivo from c)"""


def _registrations(spark, d):
    return table(spark, d, "inscripcion", "id", *_WIDE, "finalidades").dropDuplicates(["id"])


@query(f"with {_CELLS} select codigo, count(*) as celdas, count(*) filter (motivo = 'vacia') as vacias, count(*) filter (motivo = 'no_respuesta') as no_respuesta, count(*) filter (motivo is null) as respuestas from m group by 1")
def unpivot_counters(spark, d):
    return ingest.cell_counters(ingest.unpivoted(_registrations(spark, d), ["id"], _WIDE))


@query(f"""with {_CELLS}, k as (select documento, min(id_persona) as persona, count(distinct id_persona) as n from persona where documento is not null group by 1),
 f as (select m.*, case when k.n = 1 then k.persona end as persona, coalesce(list_contains(finalidades, 'contacto_participacion'), false) as permiso from m left join k using (documento)),
 r as (select *, case when motivo is not null then motivo when persona is null then 'sin_persona' when not permiso then 'sin_permiso' else 'cargada' end as destino, sha256(codigo || ' → ' || trim(valor, ' ')) as hash from f)
select destino, count(*) as celdas, count(distinct id) as filas, count(distinct persona) as personas, count(distinct case when destino = 'cargada' then hash end) as unidades from r group by 1""")
def ingest_summary(spark, d):
    cells = ingest.ingested(_registrations(spark, d), "id", _WIDE, "documento", table(spark, d, "persona", "documento", "id_persona"), F.array_contains("finalidades", "contacto_participacion"))
    return ingest.summary(cells, "id")


@query(f"""with {_CELLS}, v as (select codigo, valor, count(*) as n from c where trim(valor, ' ') <> '' group by all), q as (select distinct codigo from c), t as (select count(*) as filas from i),
 r as (select q.codigo, coalesce(sum(n), 0)::bigint as respuestas, coalesce(max(n), 0) as mayor, coalesce(sum(n) filter (list_contains({_NO}, trim(strip_accents(lower(valor)), ' '))), 0)::bigint as nr,
  coalesce(sum(n) filter (valor <> trim(valor, ' ')), 0)::bigint as espacios, coalesce(sum(n) filter (regexp_matches(valor, '[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+')), 0)::bigint as correos,
  coalesce(sum(n) filter (regexp_matches(valor, '[ÃÂ][\\x{{80}}-\\x{{bf}}]')), 0)::bigint as rotos from q left join v using (codigo) group by 1),
 g as (select v.codigo, count(distinct valor) as formas, count(distinct trim(strip_accents(lower(valor)), ' ')) as plegadas from v group by 1),
 h as (select codigo, 'variable_vacia' as tipo, 2 as severidad, filas as cuantos from r, t where respuestas = 0
  union all select codigo, 'casi_constante', 3, mayor from r where respuestas >= 20 and mayor >= 0.95 * respuestas
  union all select codigo, 'no_respuesta', 2, nr from r where nr > 0 union all select codigo, 'datos_personales', 1, correos from r where correos > 0
  union all select codigo, 'espacios', 3, espacios from r where espacios > 0 union all select codigo, 'codificacion', 1, rotos from r where rotos > 0
  union all select codigo, 'formas_de_un_valor', 3, formas - plegadas from g where formas > plegadas
  union all select codigo, 'mayormente_vacia', 3, filas - respuestas from r, t where respuestas > 0 and respuestas < 0.5 * filas)
select codigo, tipo, severidad::int as severidad, cuantos::bigint as cuantos, row_number() over (order by severidad, cuantos desc, codigo, tipo)::int as orden from h""")
def file_diagnosis(spark, d):
    wide = _registrations(spark, d)
    return diagnosis.diagnosed(ingest.unpivoted(wide, ["id"], _WIDE), wide.count(), kinds=("correo",))


@query(f"""with {_CELLS}, v as (select codigo, valor, count(*) as n from c where trim(valor, ' ') <> '' group by all), r as (select *, row_number() over (partition by codigo order by n desc, valor) as k, count(*) over (partition by codigo) as m from v)
select codigo, valor, n, (k - (m - 3) // 2)::int as lugar from r where k between (m - 3) // 2 + 1 and (m - 3) // 2 + 3 and m >= 9""")
def middle_values(spark, d):
    return diagnosis.middle(ingest.distributions(ingest.unpivoted(_registrations(spark, d), ["id"], _WIDE)))


# --- people -------------------------------------------------------------------------------------------------------

_AT = "timestamp '2025-01-01 00:00:00'"


@query(f"""with p as (select distinct id_persona, fecha_nacimiento from persona),
 a as (select distinct * from persona_atributo where (categoria_id is not null or valor_num is not null or valor_fecha is not null) and (desde is null or desde <= {_AT}) and (hasta is null or hasta > {_AT})),
 v as (select * from a qualify row_number() over (partition by id_persona, atributo_id order by desde desc nulls last, actualizado_en desc, id desc) = 1),
 e as (select id_persona, valor_num, fecha_referencia from v where atributo_id = 3 and valor_num is not null), b as (select id_persona, clave from v join atributo_categoria c on c.id = v.categoria_id where v.atributo_id = 2),
 x as (select id_persona, case when fecha_nacimiento is not null then 2025 - year(fecha_nacimiento) - case when strftime({_AT}, '%m%d') < strftime(fecha_nacimiento, '%m%d') then 1 else 0 end
   when valor_num is not null then floor(valor_num)::bigint + case when fecha_referencia is null then 0 else greatest(0, 2025 - year(fecha_referencia) - case when strftime({_AT}, '%m%d') < strftime(fecha_referencia, '%m%d') then 1 else 0 end) end end as edad,
  case when fecha_nacimiento is not null then 'derivado' when valor_num is not null then 'envejecido' when clave is not null then 'tramo_guardado' end as procedencia, clave from p left join e using (id_persona) left join b using (id_persona))
select id_persona, edad::int as edad, procedencia, case when edad is null then clave when edad < 18 then '<18' when edad < 25 then '18-24' when edad < 35 then '25-34' when edad < 45 then '35-44' when edad < 55 then '45-54' when edad < 65 then '55-64' else '65+' end as tramo_etario
from x where procedencia is not null""")
def age_with_provenance(spark, d):
    at = F.expr("timestamp_ntz '2025-01-01 00:00:00'")
    return segments.aged(roles.people(spark, d), table(spark, d, "persona_atributo"), table(spark, d, "atributo_categoria"), at, declared=3, band=2)


@query(f"""with {panel._PROFILE} select persona, ultimo_contacto, row_number() over (order by ultimo_contacto, persona)::int as puesto from prof where convocatorias > 0 and respuestas = 0 qualify puesto <= 15""")
def dormant_people(spark, d):
    from cohortia.operators.participation import dormant

    return dormant(panel._profiles(spark, d), "persona", 15)


@query("""with d as (select encuesta_id, min(creado_en) as primera, count(*) as respuestas, count(distinct id_persona) as personas from documents where encuesta_id is not null group by 1)
select encuesta_id, respuestas, personas, row_number() over (order by primera desc nulls last, encuesta_id)::int as orden from d""")
def load_list(spark, d):
    """Loads, the newest first, with their answers and people."""
    from pyspark.sql import Window

    loads = table(spark, d, "documents", "encuesta_id", "creado_en", "id_persona").filter("encuesta_id is not null").groupBy("encuesta_id")
    listed = loads.agg(F.min("creado_en").alias("primera"), F.count(F.lit(1)).alias("respuestas"), F.count_distinct("id_persona").alias("personas"))
    return listed.select("encuesta_id", "respuestas", "personas", F.row_number().over(Window.orderBy(F.desc_nulls_last("primera"), "encuesta_id")).alias("orden"))


@query(f"""with p as (select distinct id_persona, documento, email, celular from persona), i as (select distinct id, documento, email, celular, nombre, id_persona_previa, origen from inscripcion),
 al as (select distinct coalesce(origen, '') || '|' || nombre as v, id_persona from inscripcion where nombre is not null and id_persona is not null),
 k as (select 'uuid' as tipo, id_persona as v, id_persona from p union all select 'documento', documento, id_persona from p union all select 'email', lower(trim(email, ' ')), id_persona from p
  union all select 'celular', {answers._FONO}, id_persona from p, {answers._PHONE.format(c="p.celular")} union all select 'alias', v, id_persona from al),
 o as (select tipo, v, min(id_persona) as persona, count(distinct id_persona) as n from k where v is not null and v <> '' group by all),
 c as (select id, unnest([{{'tipo': 'uuid', 'valor': id_persona_previa}}, {{'tipo': 'documento', 'valor': documento}}, {{'tipo': 'email', 'valor': email}}, {{'tipo': 'celular', 'valor': celular}}, {{'tipo': 'alias', 'valor': nombre}}, {{'tipo': 'otro', 'valor': nombre}}], recursive := true), origen from i),
 w as (select c.*, nullif(case tipo when 'email' then lower(trim(valor, ' ')) when 'celular' then {answers._FONO} when 'alias' then case when trim(valor, ' ') <> '' then coalesce(origen, '') || '|' || trim(valor, ' ') end else trim(valor, ' ') end, '') as v from c, {answers._PHONE.format(c="trim(c.valor, ' ')")})
select id, w.tipo, valor, case when w.tipo <> 'otro' and n = 1 then persona end as persona, case when w.tipo = 'otro' then 'tipo_desconocido' when v is null then 'vacio' when n is null then 'desconocido' when n > 1 then 'ambiguo' end as motivo from w left join o using (tipo, v)""")
def identifiers_by_kind(spark, d):
    entries = table(spark, d, "inscripcion", "id", "documento", "email", "celular", "nombre", "id_persona_previa", "origen").dropDuplicates(["id"])
    fields = {"uuid": "id_persona_previa", "documento": "documento", "email": "email", "celular": "celular", "alias": "nombre", "otro": "nombre"}
    values = entries.select("id", "origen", F.explode(F.array(*(F.struct(F.lit(k).alias("tipo"), F.col(c).alias("valor")) for k, c in fields.items()))).alias("x")).select("id", "origen", "x.*")
    aliases = table(spark, d, "inscripcion", "origen", F.col("nombre").alias("alias"), "id_persona").filter("id_persona is not null")
    return identity.resolve_typed(values, roles.people(spark, d), aliases).select("id", "tipo", "valor", "persona", "motivo")


# --- topics -------------------------------------------------------------------------------------------------------

_TOPICS = """hechos as (select distinct id_persona as persona, source as tema from documents where id_persona is not null and source is not null),
 temas as (select distinct source as tema, case when contains(source, '_') then split_part(source, '_', 1) else 'general' end as area, source = 'grupo_focal' as especial from documents where source is not null),
 e as (select tema, area, especial or bool_or(especial) over (partition by area) as especial from temas)"""


@query(f"""with {_TOPICS} select distinct persona from hechos join e using (tema) where not especial and (tema in ('kiosco') or strip_accents(lower(tema)) in ('buzon_papel') or area in ('campo', 'grupo'))""")
def people_by_topics(spark, d):
    area = F.when(F.contains("tema", F.lit("_")), F.split_part("tema", F.lit("_"), F.lit(1))).otherwise("general")
    facts = table(spark, d, "documents", F.col("id_persona").alias("persona"), F.col("source").alias("tema")).filter("persona is not null and tema is not null").distinct()
    catalogue = facts.unionByName(table(spark, d, "documents", F.lit(None).cast("string").alias("persona"), F.col("source").alias("tema"))).filter("tema is not null").select("tema").distinct()
    catalogue = catalogue.select("tema", area.alias("area"), (F.col("tema") == "grupo_focal").alias("especial"))
    return topics.people_with(facts, catalogue, "persona", ids=["kiosco"], names=["Buzón_papel"], areas=["campo", "grupo"])


@query(f"""with {_TOPICS} select distinct persona from hechos join e using (tema) where tema in ('kiosco') or area in ('grupo')""")
def people_by_special_topics(spark, d):
    area = F.when(F.contains("tema", F.lit("_")), F.split_part("tema", F.lit("_"), F.lit(1))).otherwise("general")
    facts = table(spark, d, "documents", F.col("id_persona").alias("persona"), F.col("source").alias("tema")).filter("persona is not null and tema is not null").distinct()
    catalogue = facts.select("tema").distinct().select("tema", area.alias("area"), (F.col("tema") == "grupo_focal").alias("especial"))
    return topics.people_with(facts, catalogue, "persona", ids=["kiosco"], areas=["grupo"], special=True)


# --- semantic -----------------------------------------------------------------------------------------------------


@query(f"select id_persona, puntaje, estado, row_number() over (order by puntaje desc, id_persona)::int as puesto from ({answers.S['combine_lax']}) where exclusion is null qualify puesto <= 50")
def ranked_people(spark, d):
    return semantic.ranking(answers.combine_lax(spark, d), "id_persona", 50).select("id_persona", "puntaje", "estado", "puesto")


@query("""with u as (select sha256(text) as hash, count(distinct id_persona) as personas from documents where trim(text, ' ') <> '' group by 1)
select count(*) as unidades, max(personas) as mayor, median(personas) as mediana, count(*) filter (personas = 1) as de_una from u""")
def units_summary(spark, d):
    return semantic.units_summary(answers.evidence_units(spark, d))


@query(f"""with {answers._DISTANCE}, a as (select sha256(text) as hash, doc_id from documents where trim(text, ' ') <> '' and id_persona in (select id_persona from membresia where estado = 'activo')),
 u as (select hash, min(doc_id) as vec_id from a group by 1) select hash, vec_id, round(distancia, 6) as distancia from u join e using (vec_id) where distancia <= 0.9""")
def eligible_units(spark, d):
    allowed = roles.active(spark, d).select("id_persona").distinct()
    return semantic.eligible(roles.answers(spark, d), allowed, "id_persona", "doc_id", "text", table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _query_vector(spark, d), 0.9).withColumnRenamed("doc_id", "vec_id").withColumn("distancia", F.round("distancia", 6))


@query(f"""with {_judged_sql(CRITERIA[:1])}, n as (select hash, ((row_number() over (order by hash) - 1) // 100)::bigint as lote from t)
select hash, lote, case when lote < 6 then veredicto else 'sin_verificar' end as veredicto from n join j using (hash) where criterio = 0""")
def exhaustive_verdicts(spark, d):
    frozen = semantic.frozen_batches(answers.evidence_units(spark, d).select("hash", "texto"), 100)
    known = semantic.verdict_upsert(None, semantic.process_batches(frozen, CRITERIA[0], first=0, last=3))
    known = semantic.verdict_upsert(known, semantic.process_batches(frozen, CRITERIA[0], first=3, last=6))
    return semantic.assembled(frozen, known).select("hash", "lote", "veredicto")


@query("select count(*) filter (vec_id % 20 = 0) as consultas, true as suficiente from embeddings")
def ann_recall(spark, d):
    """Whether the approximate search finds at least 0.9 of the exact neighbours of every 20th vector, on average."""
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    audit = ann.audit(answers._each(spark, d), ann_topk_each(spark, d), "vec_id")
    asked = vectors.filter("vec_id % 20 = 0").agg(F.count(F.lit(1)).alias("consultas"))
    mean = audit.agg(F.avg("exactitud")).scalar()
    return asked.select("consultas", (mean >= 0.9).alias("suficiente"))


@query()
def ann_topk_each(spark, d):
    """The 50 nearest of every 20th vector by the index."""
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    index = ann.fitted(vectors, "vec_id", "embedding")
    return ann.search(index, vectors, vectors.filter("vec_id % 20 = 0"), 50, "vec_id", "embedding")


@query()
def ann_recall_audit(spark, d):
    """By query: how many exact neighbours the index misses, their first exact place, and the share it finds."""
    return ann.audit(answers._each(spark, d), ann_topk_each(spark, d), "vec_id")


QUERIES, SQL = Q, S
