"""Queries of answer quality, semantic search, change over time, ingestion and profiling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortia.functions.expressions import phone_key
from cohortia.functions.polarity import ADHESION, EMPTY, NEGATORS, REJECTION, VERIFIER_EMPTY, words_of
from cohortia.operators import identity, ingest, ledger, longitudinal, profiling, quality, semantic, topics
from cohortia.plans import roles
from cohortia.plans.roles import CUSTOMERS, PART
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


# --- quality ------------------------------------------------------------------------------------------------------

_LINES = """sl as (select l_orderkey as persona, count(*) as items, round(var_pop(l_quantity), 6) as varianza, count(distinct l_quantity) as distintos from lineitem group by 1 having count(*) >= 4)"""


@query(f"with {_LINES} select persona, items, varianza, 0::bigint as no_numericos, distintos, varianza < 40 as plano from sl")
def straightliner_flags(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_quantity").select(F.col("l_orderkey").alias("persona"), F.col("l_quantity").alias("valor"))
    return quality.straight_lines(lines, ["persona"], threshold=40)


@query("select event_id, value < 5 as rapido from events")
def speeder_flags(spark, d):
    return table(spark, d, "events", "event_id", "value").select("event_id", quality.speeder(F.col("value"), 5).alias("rapido"))


@query("""with h as (select id_persona, concat_ws('-', count(*), sum(('0x' || substr(md5(text), 1, 12))::bigint), sum(('0x' || substr(md5(text), 13, 12))::bigint)) as huella from documents where text is not null and id_persona is not null group by 1)
select huella, count(*) as personas, min(id_persona) as primera from h group by 1 having count(*) > 1""")
def duplicate_content_groups(spark, d):
    return quality.same_content(roles.answers(spark, d).filter("id_persona is not null"), "id_persona", "text")


@query(f"""with {_LINES}, o as (select o_orderkey, o_orderstatus = 'F' as respondio, case when o_orderpriority = '1-URGENT' then 'ok' end as revisado, o_totalprice < 20000 as rapido from orders),
 x as (select o.*, varianza < 40 as plano from o left join sl on persona = o_orderkey),
 m as (select *, concat_ws(',', case when coalesce(rapido, false) then 'rapido' end, case when coalesce(plano, false) then 'plano' end) as r from x)
select o_orderkey, coalesce(revisado, case when not respondio then 'pendiente' when r <> '' then 'sospechoso' else 'ok' end) as estado, case when revisado is null and respondio then r else '' end as motivos from m""")
def quality_run(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    facts = orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("respondio"), F.when(F.col("o_orderpriority") == "1-URGENT", "ok").alias("revisado"), (F.col("o_totalprice") < 20000).alias("rapido"))
    flat = straightliner_flags(spark, d).select(F.col("persona").alias("o_orderkey"), "plano")
    return quality.run(facts.join(flat, "o_orderkey", "left").withColumn("copia", F.lit(None).cast("boolean"))).select("o_orderkey", "estado", "motivos")


@query("select id, count(*) as veces from inscripcion group by 1 having count(*) > 1")
def repeated_ids(spark, d):
    return quality.repeated_ids(table(spark, d, "inscripcion", "id"), "id")


# --- identity -----------------------------------------------------------------------------------------------------

_PHONE = """lateral (select regexp_replace(trim({c}), '^00', '+') as m) l1, lateral (select regexp_replace(m, '[^0-9]', '', 'g') as g) l2,
 lateral (select case when starts_with(m, '+') or (starts_with(g, '598') and length(g) > 3) then g else '598' || ltrim(g, '0') end as w) l3"""
_FONO = "case when length(g) > 0 and length(w) between 8 and 15 then '+' || w end"


def _words(c: str) -> str:
    folded = f"trim(strip_accents(lower({c})))"
    return f"list_sort(list_distinct(list_filter(string_split(regexp_replace({folded}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')))"


def _people_fields(spark, d):
    return roles.people(spark, d).select("id_persona", "nombre", "documento", "email", "celular", "fecha_nacimiento")


def _entries(spark, d):
    return table(spark, d, "inscripcion", "id", "nombre", "documento", "email", "celular", "fecha_nacimiento").dropDuplicates(["id"])


_DECIDE = f"""with p as (select distinct id_persona, nombre, documento, email, celular, fecha_nacimiento from persona),
 i as (select distinct id, nombre, documento, lower(trim(email)) as mail, celular, fecha_nacimiento from inscripcion),
 pf as (select p.*, lower(trim(p.email)) as m2, {_FONO} as fono from p, {_PHONE.format(c="p.celular")}),
 jf as (select i.*, {_FONO} as fono from i, {_PHONE.format(c="i.celular")}),
 bd as (select documento, min(id_persona) as p_documento from p where documento is not null and documento <> '' group by 1),
 bm as (select m2 as mail, min(id_persona) as p_email from pf where m2 is not null and m2 <> '' group by 1),
 h as (select j.id, count(distinct q.id_persona) as duenos, count(*) filter (not coalesce(j.documento <> q.documento or j.mail <> q.m2, false)) as posibles,
  min(case when not coalesce(j.documento <> q.documento or j.mail <> q.m2, false) then q.id_persona end) as p_celular,
  bool_or(list_has_all({_words("coalesce(q.nombre, '')")}, {_words("coalesce(j.nombre, '')")}) or list_has_all({_words("coalesce(j.nombre, '')")}, {_words("coalesce(q.nombre, '')")})) as compatible
  from jf j join pf q on j.fono = q.fono group by 1),
 bn as (select lower(nombre) || '|' || fecha_nacimiento::varchar as nn, min(id_persona) as p_nombre from p where fecha_nacimiento is not null and nombre is not null group by 1),
 x as (select j.id, j.documento, j.mail, p_documento, p_email, p_celular, p_nombre, duenos, posibles, compatible from jf j left join bd using (documento) left join bm using (mail) left join h using (id) left join bn on nn = lower(j.nombre) || '|' || j.fecha_nacimiento::varchar),
 r as (select *, case when p_documento is not null then 'documento' when p_email is not null then 'email' when posibles > 0 then case when duenos = 1 and compatible then 'celular' else 'celular_dudoso' end
  when documento is null and mail is null and p_nombre is not null then 'nombre_fecha' else 'ninguna' end as regla from x)"""


@query(_DECIDE + """ select id, case when regla in ('documento', 'email', 'celular') then 'reutiliza' when regla = 'ninguna' then 'crea' else 'revision' end as decision,
 case regla when 'documento' then p_documento when 'email' then p_email when 'celular' then p_celular when 'nombre_fecha' then p_nombre end as persona, regla from r""")
def dedup_cascade(spark, d):
    return identity.decide(_entries(spark, d), _people_fields(spark, d))


@query(f"""with p as (select distinct id_persona, celular from persona), i as (select distinct id, celular from inscripcion),
 o as (select {_FONO} as fono, count(distinct id_persona) as duenos, min(id_persona) as persona from p, {_PHONE.format(c="p.celular")} where {_FONO} is not null group by 1),
 j as (select id, celular, {_FONO} as fono from i, {_PHONE.format(c="i.celular")})
select id, celular, case when fono is null or duenos is null or duenos > 1 then null else persona end as persona,
 case when fono is null then 'vacio' when duenos is null then 'desconocido' when duenos > 1 then 'ambiguo' end as motivo from j left join o using (fono)""")
def identifier_resolution(spark, d):
    owned = identity.owners(roles.people(spark, d), phone_key(F.col("celular")))
    return identity.resolve(_entries(spark, d).select("id", "celular"), owned, phone_key(F.col("celular")))


@query("""with p as (select distinct id_persona, documento, email, nombre, fecha_nacimiento from persona), i as (select distinct id, documento, email, nombre, fecha_nacimiento from inscripcion),
 u as (select i.id, p.id_persona, 'documento' as clave from i join p on i.documento = p.documento where i.documento <> ''
  union all select i.id, p.id_persona, 'email' from i join p on lower(trim(i.email)) = lower(trim(p.email)) where trim(i.email) <> ''
  union all select i.id, p.id_persona, 'nombre_fecha' from i join p on lower(i.nombre) = lower(p.nombre) and i.fecha_nacimiento = p.fecha_nacimiento)
select id, id_persona, count(distinct clave) as coincidencias, array_to_string(list_sort(list_distinct(list(clave))), ',') as claves from u group by all""")
def candidates_by_coincidence(spark, d):
    dated = F.when(F.col("nombre").isNotNull() & F.col("fecha_nacimiento").isNotNull(), F.concat_ws("|", F.lower("nombre"), F.col("fecha_nacimiento").cast("string")))
    keys = {"documento": F.col("documento"), "email": F.lower(F.trim("email")), "nombre_fecha": dated}
    return identity.candidates(_entries(spark, d), _people_fields(spark, d), keys, "id", "id_persona")


@query("""with x as (select 'documento' as clave, documento as valor from inscripcion union all select 'email', lower(email) from inscripcion union all select 'localidad', localidad from inscripcion),
 c as (select clave, valor, count(*) as k from x group by all), g as (select *, valor is not null and valor <> '' as dado from c),
 s as (select clave, sum(k)::bigint as filas, sum(case when dado then k else 0 end)::bigint as con_valor, count(*) filter (dado) as distintos,
  sum(case when dado and k > 1 then k else 0 end)::bigint as repetidas, coalesce(max(case when dado then k end), 0) as mayor from g group by 1)
select *, con_valor >= 10 and con_valor - distintos >= 0.5 * con_valor as sospechosa from s""")
def dedup_key_stats(spark, d):
    keys = {"documento": F.col("documento"), "email": F.lower("email"), "localidad": F.col("localidad")}
    return identity.key_statistics(table(spark, d, "inscripcion", "documento", "email", "localidad"), keys)


@query("""with k as (select case when documento is not null then 'd' || documento when email is not null then 'e' || lower(email) when nombre is not null then 'n' || lower(nombre) || coalesce(fecha_nacimiento::varchar, '') end as clave from inscripcion)
select count(*) as filas, count(distinct clave) as personas, count(*) filter (clave is null) as sin_clave from k""")
def estimated_people(spark, d):
    key = F.coalesce(F.concat(F.lit("d"), "documento"), F.concat(F.lit("e"), F.lower("email")), F.concat(F.lit("n"), F.lower("nombre"), F.coalesce(F.col("fecha_nacimiento").cast("string"), F.lit(""))))
    keyed = table(spark, d, "inscripcion", "documento", "email", "nombre", "fecha_nacimiento").select(key.alias("k"))
    return keyed.agg(F.count(F.lit(1)).alias("filas"), F.count_distinct("k").alias("personas"), F.count_if(F.col("k").isNull()).alias("sin_clave"))


# --- semantic -----------------------------------------------------------------------------------------------------

CRITERIA = [semantic.SemanticCriterion("gente conforme con la tarjeta de puntos o el precio"), semantic.SemanticCriterion("personas que compran en el almacén de la cooperativa", 2.0)]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _judged_sql(criteria) -> str:
    """SQL of the lexical verdicts over texts t(hash, texto)."""
    parts = []
    for k, c in enumerate(criteria):
        content = [w for w in words_of(c.text) if w not in EMPTY and len(w) > 2]
        checked = [w for w in words_of(c.text) if w not in VERIFIER_EMPTY and len(w) > 2]
        parts.append(f"""select hash, {k} as criterio, signo = -1 as op, len(list_intersect(p, {_list(content)})) / {len(content)} as so, len(list_intersect(p, {_list(checked)})) / {len(checked)} as sv from g""")
    phrases = " or ".join(f"contains(plano, '{w}')" for w in ADHESION if " " in w)
    return f"""t as (select sha256(text) as hash, min(text) as texto from documents where trim(text, ' ') <> '' group by 1),
 f as (select hash, trim(strip_accents(lower(texto)), ' ') as plano from t), w as (select hash, plano, list_distinct(regexp_extract_all(plano, '[a-z0-9]+')) as p from f),
 g as (select hash, p, case when list_has_any(p, {_list(NEGATORS + REJECTION)}) then -1 when list_has_any(p, {_list([w for w in ADHESION if " " not in w])}) or {phrases} then 1 else 0 end as signo from w),
 raw as ({" union all ".join(parts)}),
 j as (select hash, criterio, case when op then 'no_cumple' when sv >= 0.34 then 'cumple' when sv = 0 then 'irrelevante' else 'dudoso' end as veredicto, greatest(0, least(1, round(so - case when op then 2 else 0 end, 6))) as relevancia from raw)"""


@query("""select sha256(text) as hash, min(text) as texto, count(*) as respuestas, count(distinct id_persona) as personas, count(distinct encuesta_id) as preguntas, min(doc_id) as representante
from documents where trim(text, ' ') <> '' group by 1""")
def evidence_units(spark, d):
    return semantic.units(roles.answers(spark, d), "text", "doc_id", "id_persona", "encuesta_id")


def _query_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


_DISTANCE = """e as (select vec_id, label, list_cosine_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as distancia from embeddings)"""


@query(f"with {_DISTANCE} select vec_id, round(distancia, 6) as distancia, row_number() over (order by distancia, vec_id)::int as puesto from e order by 3 limit 50")
def knn_exact_topk(spark, d):
    return semantic.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 50, "vec_id", "embedding").withColumn("distancia", F.round("distancia", 6))


@query(f"with {_DISTANCE} select vec_id, round(distancia, 6) as distancia, row_number() over (order by distancia, vec_id)::int as puesto from e where label <> 3 order by 3 limit 50")
def knn_gated_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return semantic.nearest(vectors, _query_vector(spark, d), 50, "vec_id", "embedding", vectors.filter("label <> 3").select("vec_id")).withColumn("distancia", F.round("distancia", 6))


@query(f"""with {_DISTANCE}, a as (select * from e order by distancia, vec_id limit 50), b as (select * from e where label <> 3 order by distancia, vec_id limit 50)
select vec_id, row_number() over (order by distancia, vec_id)::int as puesto from a qualify vec_id not in (select vec_id from b)""")
def recall_audit(spark, d):
    vectors, q = table(spark, d, "embeddings"), _query_vector(spark, d)
    exact = semantic.nearest(vectors, q, 50, "vec_id", "embedding")
    return semantic.recall_of(exact, semantic.nearest(vectors.filter("label <> 3"), q, 50, "vec_id", "embedding"), "vec_id")


_EACH = """e as (select q.vec_id as consulta, v.vec_id, v.label, list_cosine_distance(v.embedding::double[], q.embedding::double[]) as distancia from embeddings q, embeddings v where q.vec_id % 20 = 0)"""
_TOP = "row_number() over (partition by consulta order by distancia, vec_id)::int as puesto"


def _each(spark, d, gated: bool = False):
    """The 50 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, d, "embeddings")
    allowed = vectors.filter("label <> 3").select("vec_id") if gated else None
    return semantic.nearest_each(vectors.select("vec_id", "embedding"), vectors.filter("vec_id % 20 = 0"), 50, "vec_id", "embedding", allowed)


@query(f"with {_EACH} select consulta, vec_id, round(distancia, 6) as distancia, {_TOP} from e qualify puesto <= 50")
def knn_exact_topk_each(spark, d):
    return _each(spark, d).withColumn("distancia", F.round("distancia", 6))


@query(f"with {_EACH} select consulta, vec_id, round(distancia, 6) as distancia, {_TOP} from e where label <> 3 qualify puesto <= 50")
def knn_gated_topk_each(spark, d):
    return _each(spark, d, gated=True).withColumn("distancia", F.round("distancia", 6))


@query(f"""with {_EACH}, a as (select *, {_TOP} from e qualify puesto <= 50), b as (select *, {_TOP} from e where label <> 3 qualify puesto <= 50)
select consulta, vec_id, a.puesto from a anti join b using (consulta, vec_id)""")
def recall_audit_each(spark, d):
    return semantic.recall_of(_each(spark, d), _each(spark, d, gated=True), "vec_id")


@query(f"with {_DISTANCE} select 17::bigint as vec_id, count(*) as delante from e where round(distancia, 9) < (select round(distancia, 9) from e where vec_id = 17)")
def rank_of_evidence(spark, d):
    return semantic.rank_of(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", 17)


@query("""with r as (select embedding::double[] as e from embeddings where label = 0), c as (select vec_id, embedding::double[] as e from embeddings where label <> 0),
 x as (select vec_id, round(min(list_cosine_distance(c.e, r.e)), 6) as distancia from c, r group by 1)
select vec_id, distancia from x where distancia <= 0.8 order by distancia, vec_id limit 20""")
def series_suggestions(spark, d):
    e = table(spark, d, "embeddings")
    return semantic.near_any(e.filter("label <> 0"), e.filter("label = 0"), "vec_id", "embedding", 0.8)


@query(f"""with {_DISTANCE}, top as (select vec_id, distancia, row_number() over (order by distancia, vec_id)::int as puesto from e order by 3 limit 30)
select doc_id, id_persona, source, puesto from documents join top on doc_id = vec_id""")
def unit_to_answers(spark, d):
    top = semantic.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), 30, "vec_id", "embedding").select("vec_id", "puesto")
    return roles.answers(spark, d).select("doc_id", "id_persona", "source").join(F.broadcast(top), F.col("doc_id") == F.col("vec_id")).drop("vec_id")


@query(f"""with {_judged_sql(CRITERIA)}, a as (select doc_id, id_persona, sha256(text) as hash from documents where trim(text, ' ') <> '' and id_persona is not null)
select id_persona, doc_id, relevancia, row_number() over (partition by id_persona order by relevancia desc, doc_id)::int as lugar from a join j using (hash) where criterio = 0 qualify lugar <= 3""")
def top3_evidence_per_person(spark, d):
    judged = semantic.judged(roles.answers(spark, d).filter("id_persona is not null"), CRITERIA[:1], "text")
    return semantic.best_evidence(judged, "id_persona", [F.desc("relevancia"), F.asc("doc_id")]).select("id_persona", "doc_id", "relevancia", "lugar")


@query(f"""with {_judged_sql(CRITERIA)} select criterio, veredicto, count(*) as unidades, round(sum(relevancia), 4) as relevancia from j group by all""")
def lexical_verdicts(spark, d):
    units = semantic.judged(evidence_units(spark, d), CRITERIA, "texto")
    return units.groupBy("criterio", "veredicto").agg(F.count(F.lit(1)).alias("unidades"), F.round(F.sum("relevancia"), 4).alias("relevancia"))


_FOUND = f"""{_judged_sql(CRITERIA)}, a as (select doc_id, id_persona, sha256(text) as hash from documents where trim(text, ' ') <> '' and id_persona is not null),
 fi as (select id_persona, criterio, veredicto, relevancia as puntaje, doc_id as evidencia from a join j using (hash)
  qualify row_number() over (partition by id_persona, criterio order by case veredicto when 'no_cumple' then 1 when 'cumple' then 2 when 'dudoso' then 3 else 5 end, relevancia desc, doc_id) = 1)"""


def _findings(spark, d):
    return semantic.findings(semantic.judged(roles.answers(spark, d).filter("id_persona is not null"), CRITERIA, "text"), "id_persona", "doc_id")


@query(f"with {_FOUND} select id_persona, criterio, veredicto, puntaje, evidencia from fi")
def person_findings(spark, d):
    return _findings(spark, d).select("id_persona", "criterio", "veredicto", "puntaje", "evidencia")


def _combined_sql(strict: bool) -> str:
    drop = "v in ('sin_evidencia', 'irrelevante', 'dudoso')" if strict else "false"
    return f"""with {_FOUND}, c as (select * from (values (0, 1.0), (1, 2.0)) c(criterio, peso)), e as (select id_persona, criterio, peso from (select distinct id_persona from fi), c),
 x as (select e.*, coalesce(veredicto, 'sin_evidencia') as v, puntaje from e left join fi using (id_persona, criterio)),
 s as (select id_persona, round(sum(case when v in ('sin_evidencia', 'irrelevante', 'no_cumple') then 0 else puntaje end * peso) / sum(peso), 4) as puntaje,
  arg_min(case when v = 'no_cumple' or ({drop}) then v end, criterio) filter (v = 'no_cumple' or ({drop})) as r, bool_or(v in ('sin_evidencia', 'dudoso', 'irrelevante')) as pen, bool_or(v in ('cumple', 'no_cumple', 'dudoso')) as per, max(puntaje) as mejor from x group by 1)
select id_persona, puntaje, case when pen then 'posible' else 'confirmada' end as estado, case when pen or 1 - coalesce(mejor, 0) > 0.55 then 'baja' else 'alta' end as confianza, coalesce(r, case when not per then 'sin_evidencia_pertinente' end) as exclusion from s"""


@query(_combined_sql(True))
def combine_strict(spark, d):
    return semantic.combined(_findings(spark, d), semantic.QuerySpec(tuple(CRITERIA)), "id_persona")


@query(_combined_sql(False))
def combine_lax(spark, d):
    return semantic.combined(_findings(spark, d), semantic.QuerySpec(tuple(CRITERIA), mode="laxo"), "id_persona")


@query(f"""with {_FOUND}, px as (select id_persona, veredicto = 'cumple' as ok, md5(id_persona || 's9') as m from fi where criterio = 0 and puntaje >= 0.15), fx as (select * from px order by m, id_persona limit 400)
select id_persona, row_number() over (order by m, id_persona)::int as lugar from fx where ok qualify lugar <= 100""")
def random_among_matching(spark, d):
    return semantic.drawn_matching(_findings(spark, d).filter("criterio = 0 and puntaje >= 0.15"), 1, "id_persona", "s9", 100)


@query("""with t as (select sha256(text) as hash, min(text) as texto from documents where trim(text, ' ') <> '' group by 1)
select count(*) as unidades, ceil(count(*) / 25)::bigint as llamadas, ceil(sum(length(texto)) * 0.25)::bigint as tokens, round(ceil(sum(length(texto)) * 0.25) / 1e6 * 3.0 * 1.25, 6) as costo from t""")
def exhaustive_cost(spark, d):
    return semantic.estimated_cost(evidence_units(spark, d))


@query("""with a as (select distinct sha256(text) as hash from documents where trim(text, ' ') <> ''), u as (select distinct sha256(text) as hash from documents where trim(text, ' ') <> '' and lang = 'es' union select sha256('huerfana'))
select case when u.hash is null then 'sin_unidad' else 'huerfana' end as problema, count(*) as n from a full join u on a.hash = u.hash where a.hash is null or u.hash is null group by 1""")
def unit_consistency(spark, d):
    answers = roles.answers(spark, d)
    stored = table(spark, d, "documents", "text", "lang").filter("trim(text) <> '' and lang = 'es'").select(F.sha2("text", 256).alias("hash")).distinct()
    stored = stored.unionByName(spark.range(1).select(F.sha2(F.lit("huerfana"), 256).alias("hash")))
    return semantic.inconsistent_units(answers, stored)


# --- change over time ---------------------------------------------------------------------------------------------


@query(f"""with {PART}, x as (select persona, max(case when ola = 1997 then calidad end) as desde, max(case when ola = 1998 then calidad end) as hasta from part where ola in (1997, 1998) group by 1) select desde, hasta, count(*) as personas from x group by all""")
def wave_transitions(spark, d):
    return longitudinal.transitions(roles.participation(spark, d), 1997, 1998, "ola", "persona", "calidad")


@query(f"""with {PART} select count(*) filter (b is null) as solo_primera, count(*) filter (a is null) as solo_segunda, count(*) filter (a is not null and b is not null) as ambas
from (select persona as a from part where ola = 1997) full join (select persona as b from part where ola = 1998) on a = b""")
def only_in_one_wave(spark, d):
    t = longitudinal.transitions(roles.participation(spark, d), 1997, 1998, "ola", "persona", "calidad")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("personas"))), F.lit(0))
    a, b = F.col("desde").isNotNull(), F.col("hasta").isNotNull()
    return t.agg(total(a & ~b).alias("solo_primera"), total(b & ~a).alias("solo_segunda"), total(a & b).alias("ambas"))


@query(f"""with {PART} select persona, ola, row_number() over w::int as paso, datediff('day', lag(convocado_en::date) over w, convocado_en::date)::int as dias from part window w as (partition by persona order by convocado_en, ola)""")
def person_timeline(spark, d):
    return longitudinal.timeline(roles.participation(spark, d), "persona", "convocado_en", "ola").select("persona", "ola", "paso", "dias")


@query("select o_custkey, o_orderpriority, o_orderdate as desde, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as hasta from orders")
def attr_interval_close(spark, d):
    changes = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return longitudinal.closed_intervals(changes, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderpriority", F.col("o_orderdate").alias("desde"), "hasta")


_LOADS = "h as (select l_partkey as persona, l_suppkey as pregunta, l_orderkey as carga, l_quantity as valor, l_shipdate as en from lineitem qualify row_number() over (partition by l_partkey, l_suppkey, l_orderkey order by l_linenumber) = 1)"


def _history(spark, d):
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    first = F.min_by(F.struct("l_quantity", "l_shipdate"), "l_linenumber").alias("x")
    return lines.groupBy(F.col("l_partkey").alias("persona"), F.col("l_suppkey").alias("pregunta"), F.col("l_orderkey").alias("carga")).agg(first).select("persona", "pregunta", "carga", F.col("x.l_quantity").alias("valor"), F.col("x.l_shipdate").alias("en"))


@query(f"with {_LOADS}, g as (select persona, count(distinct carga) as cargas, count(distinct valor) as valores from h group by all) select *, valores > 1 as cambio from g")
def changed_between_loads(spark, d):
    return longitudinal.changed_between_loads(_history(spark, d), ["persona"], "valor", "carga")


@query(f"""with {_LOADS}, k as (select *, year(en)::int as c from h), g as (select persona, arg_max(c, (en, c, carga)) as ultima, arg_max(valor, (en, c, carga)) filter (c <> 2001) as anterior, count(*) filter (c <> 2001) as otras from k group by 1)
select persona, case when otras > 0 then 'restaura' else 'borra' end as accion, anterior from g where ultima = 2001""")
def load_revert_preview(spark, d):
    history = _history(spark, d).withColumn("c", F.year("en")).withColumn("en", F.struct("en", "c", "carga"))
    return longitudinal.revert_preview(history, ["persona"], "c", 2001, "valor", "en")


@query("select id, panel_id, id_persona, case when row_number() over (partition by id_persona order by fecha_alta, id) = 1 then 'primera' else 'repetida' end as vinculo from (select distinct * from membresia)")
def first_appearance_origin(spark, d):
    links = table(spark, d, "membresia", "id", "panel_id", "id_persona", "fecha_alta").dropDuplicates(["id"])
    return longitudinal.first_appearance(links, ["id_persona"], [F.asc_nulls_last("fecha_alta"), F.asc("id")]).select("id", "panel_id", "id_persona", "vinculo")


@query("""with m as (select distinct panel_id, id_persona, fecha_alta from membresia), k as (select panel_id, id_persona, (fecha_alta, panel_id) > min((fecha_alta, panel_id)) over (partition by id_persona) as otra from m where fecha_alta is not null)
select panel_id, count(distinct case when otra then id_persona end) as reutilizados, count(distinct id_persona) as personas from k group by 1""")
def reused_people_by_load(spark, d):
    links = table(spark, d, "membresia", "panel_id", "id_persona", "fecha_alta").filter("fecha_alta is not null").distinct()
    return longitudinal.earlier_loads(links, "id_persona", "panel_id", "fecha_alta")


@query(f"""with m as (select distinct id, panel_id, id_persona, fecha_alta from membresia), v as (select panel_id, row_number() over (partition by id_persona order by fecha_alta, id) as n from m)
select panel_id, count(*) as filas, count(*) filter (n = 1) as creadas, count(*) filter (n > 1) as repetidas from v group by 1""")
def load_summary(spark, d):
    return first_appearance_origin(spark, d).groupBy("panel_id").agg(F.count(F.lit(1)).alias("filas"), F.count_if(F.col("vinculo") == "primera").alias("creadas"), F.count_if(F.col("vinculo") == "repetida").alias("repetidas"))


# --- ingestion ----------------------------------------------------------------------------------------------------


def _cells(spark, d):
    wide = roles.demographics(spark, d)
    return ingest.unpivoted(wide, ["id_persona"], ["sexo", "localidad", "tramo_etario", "edad"])


_CELLS = """demo as (select distinct id_persona, sexo, localidad, tramo_etario, edad from v_demografia),
 cel as (select id_persona, 'sexo' as codigo, sexo as valor from demo union all select id_persona, 'localidad', localidad from demo union all select id_persona, 'tramo_etario', tramo_etario from demo union all select id_persona, 'edad', edad::varchar from demo)"""


@query(f"with {_CELLS} select * from cel")
def unpivot_answers(spark, d):
    return _cells(spark, d)


@query(f"""with {_CELLS}, x as (select *, case codigo when 'sexo' then case valor when 'F' then 'Femenino' when 'M' then 'Masculino' else valor end else valor end as e from cel),
 y as (select *, case when valor is null or valor = '' then 'vacia' when lower(e) in ('ns', 'nc') or (codigo = 'sexo' and valor in ('98', '99')) then 'no_respuesta' end as motivo from x)
select id_persona, codigo, motivo, case when motivo is null then sha256(case codigo when 'sexo' then '¿Cuál es su sexo?' else codigo end || ' → ' || e) end as hash from y""")
def answer_texts(spark, d):
    questions = spark.createDataFrame([("sexo", "¿Cuál es su sexo?", {"F": "Femenino", "M": "Masculino"})], "codigo string, pregunta string, opciones map<string,string>")
    return ingest.answer_texts(_cells(spark, d), questions).select("id_persona", "codigo", "motivo", "hash")


@query(f"with {_CELLS} select codigo, valor, count(*) as n from cel where trim(valor) <> '' group by all")
def value_distribution(spark, d):
    return ingest.distributions(_cells(spark, d))


@query(f"""with {_CELLS}, p as (select codigo, count(*) as filas, count(*) filter (trim(valor) <> '') as con_dato, count(distinct case when trim(valor) <> '' then valor end) as distintos from cel group by 1) select *, con_dato = filas and distintos = filas as identificador from p""")
def variable_profile(spark, d):
    return ingest.variable_profile(_cells(spark, d))


@query("select id_persona, encuesta_id, doc_id, sha256(text) as hash from documents where id_persona is not null and text is not null qualify row_number() over (partition by id_persona, encuesta_id order by creado_en desc, doc_id desc) = 1")
def last_answers(spark, d):
    given = roles.answers(spark, d).filter("id_persona is not null and text is not null")
    last = ingest.last_answers(given, ["id_persona", "encuesta_id"], [F.desc_nulls_last("creado_en"), F.desc("doc_id")])
    return last.select("id_persona", "encuesta_id", "doc_id", F.sha2("text", 256).alias("hash"))


@query("""with t as (select sha256(text) as hash, min(text) as texto from documents where text is not null and lang is distinct from 'es' group by 1) select * from t where hash not in (select sha256(text) from documents where text is not null and lang = 'es')""")
def new_units_to_embed(spark, d):
    docs = table(spark, d, "documents", "text", "lang").filter("text is not null").select(F.col("text").alias("texto"), F.sha2("text", 256).alias("hash"), "lang")
    return ingest.new_units(docs.filter("lang is null or lang <> 'es'"), docs.filter("lang = 'es'"))


@query("""with o as (select distinct id_persona, localidad, tramo_etario from v_demografia), n as (select id_persona, min(localidad) as localidad from persona where localidad is not null group by 1)
select o.id_persona, 'localidad' as campo, o.localidad as antes, n.localidad as archivo from o join n using (id_persona) where o.localidad <> n.localidad""")
def demographic_discrepancies(spark, d):
    new = table(spark, d, "persona", "id_persona", "localidad").filter("localidad is not null").groupBy("id_persona").agg(F.min("localidad").alias("localidad"))
    return ingest.completed(roles.demographics(spark, d).select("id_persona", "localidad"), new, "id_persona", ["localidad"])[1]


@query("""with o as (select distinct id_persona, localidad from v_demografia), n as (select id_persona, min(localidad) as l from persona where localidad is not null group by 1)
select id_persona, coalesce(localidad, l) as localidad from o left join n using (id_persona)""")
def demographics_completed(spark, d):
    new = table(spark, d, "persona", "id_persona", "localidad").filter("localidad is not null").groupBy("id_persona").agg(F.min("localidad").alias("localidad"))
    return ingest.completed(roles.demographics(spark, d).select("id_persona", "localidad"), new, "id_persona", ["localidad"])[0]


@query("""with r as (select distinct id, atributo_id, valor_crudo from persona_atributo where valor_crudo is not null),
 a as (select atributo_id, clave as k, min(id) as c from atributo_categoria group by all), b as (select atributo_id, trim(strip_accents(lower(clave))) as k, min(id) as c from atributo_categoria group by all),
 e as (select atributo_id, trim(strip_accents(lower(etiqueta))) as k, min(id) as c from atributo_categoria group by all)
select r.id, coalesce(a.c, b.c, e.c) as categoria_id from r left join a on a.atributo_id = r.atributo_id and a.k = trim(valor_crudo, ' ') left join b on b.atributo_id = r.atributo_id and b.k = trim(strip_accents(lower(valor_crudo)), ' ')
 left join e on e.atributo_id = r.atributo_id and e.k = trim(strip_accents(lower(valor_crudo)), ' ')""")
def exact_categories(spark, d):
    raw = table(spark, d, "persona_atributo", "id", "atributo_id", "valor_crudo").filter("valor_crudo is not null").dropDuplicates(["id"])
    categories = table(spark, d, "atributo_categoria", "id", "atributo_id", "clave", "etiqueta").withColumnRenamed("id", "cid")
    return ingest.canonical(raw, categories.withColumnRenamed("cid", "id"), "valor_crudo", "atributo_id").select("id", "categoria_id")


@query("""with o as (select doc_id, sha256(text) as hash from documents where text is not null and source <> 'kiosco'), n as (select doc_id, sha256(case when lang = 'pt' then text || '!' else text end) as hash from documents where text is not null and source <> 'portal_panelista')
select coalesce(o.doc_id, n.doc_id) as doc_id, case when n.hash is null then 'borra' when o.hash = n.hash then 'conserva' else 'reembebe' end as accion from o full join n on o.doc_id = n.doc_id""")
def reprocess_plan(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source").filter("text is not null")
    old = docs.filter("source <> 'kiosco'").select("doc_id", F.sha2("text", 256).alias("hash"))
    new = docs.filter("source <> 'portal_panelista'").select("doc_id", F.sha2(F.when(F.col("lang") == "pt", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return ingest.reprocessed(old, new, ["doc_id"])


@query("""with o as (select distinct id_persona, localidad as valor from v_demografia), n as (select id_persona, min(nombre) as valor from persona where nombre is not null group by 1) select * from o where id_persona not in (select id_persona from n) union all select * from n""")
def upserted_answers(spark, d):
    new = table(spark, d, "persona", "id_persona", "nombre").filter("nombre is not null").groupBy("id_persona").agg(F.min("nombre").alias("valor"))
    return ingest.upserted(roles.demographics(spark, d).select("id_persona", F.col("localidad").alias("valor")), new, ["id_persona"])


# --- profiling ----------------------------------------------------------------------------------------------------


@query("""with x as (select 'estado' as codigo, estado as valor from inscripcion union all select 'origen', origen from membresia m join (select 1 as u, 'x' as origen) on true union all select 'panel', panel_id::varchar from membresia),
 v as (select codigo, valor, count(*) as n from x where valor is not null group by all), w as (select *, sum(n) over (partition by codigo)::bigint as respuestas from v)
select codigo, valor, round(n / respuestas, 4) as proporcion, respuestas from w where respuestas >= 20 and n >= 0.95 * respuestas""")
def near_constant_vars(spark, d):
    cells = table(spark, d, "inscripcion").select(F.lit("estado").alias("codigo"), F.col("estado").alias("valor"))
    members = table(spark, d, "membresia", "panel_id")
    cells = cells.unionByName(members.select(F.lit("origen").alias("codigo"), F.lit("x").alias("valor"))).unionByName(members.select(F.lit("panel").alias("codigo"), F.col("panel_id").cast("string").alias("valor")))
    return profiling.near_constant(ingest.distributions(cells))


@query(r"""with t as (select source, doc_id, text from documents where text is not null),
 e as (select source, doc_id, regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+') as c, regexp_extract_all(regexp_replace(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+', '·', 'g'), '(?i)(?:https?://|www\.)\S+') as u from t)
select source, 'correo' as tipo, count(*) filter (len(c) > 0) as filas, sum(len(c))::bigint as hallazgos from e group by 1 having sum(len(c)) > 0
union all select source, 'url', count(*) filter (len(u) > 0), sum(len(u))::bigint from e group by 1 having sum(len(u)) > 0""")
def pii_counts(spark, d):
    return profiling.personal_counts(table(spark, d, "documents", "source", "text"), "text", "source").filter("tipo in ('correo', 'url')")


@query()
def pii_counts_numbers(spark, d):
    """National numbers with a valid check digit and phones, whose patterns look behind; tested on a fixture."""
    return profiling.personal_counts(table(spark, d, "documents", "source", "text"), "text", "source").filter("tipo in ('cedula', 'telefono')")


@query(f"""with t as (select source, trim(strip_accents(lower(text)), ' ') as t from documents) select source, count(*) as textos, count(*) filter (t in {tuple(w.replace("'", "''") for w in ingest.NO_ANSWER if "'" not in w)}) as no_respuesta, count(*) filter (t is null or t = '') as vacios from t group by 1""")
def no_answer_counts(spark, d):
    return profiling.no_answers(table(spark, d, "documents", "source", "text"), "text", "source")


_DIST = f"{_CELLS}, dis as (select codigo, valor, count(*) as n from cel where trim(valor) <> '' group by all)"


@query(f"""with {_DIST}, k as (select *, row_number() over (partition by codigo order by n desc, valor)::int as h, row_number() over (partition by codigo order by n, valor)::int as l from dis)
select codigo, 'mas' as extremo, h as lugar, valor, n from k where h <= 3 union all select codigo, 'menos', l, valor, n from k where l <= 3""")
def value_preview(spark, d):
    return profiling.preview(value_distribution(spark, d))


@query(f"""with {_DIST}, t as (select codigo, count(*) as valores, count(*) filter (try_cast(valor as double) is null) as nn, count(*) filter (not coalesce(regexp_matches(valor, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), false)) as nf from dis group by 1)
select codigo, case when nf = 0 then 'fecha' when nn = 0 and valores > 12 then 'numerica' when valores <= 12 then 'cerrada' else 'abierta' end as tipo, valores from t""")
def inferred_types(spark, d):
    return profiling.inferred_types(value_distribution(spark, d))


# --- topics and ledger --------------------------------------------------------------------------------------------

_TOPICS = "fac as (select distinct id_persona as persona, source as tema, case when source in ('kiosco', 'foro_cerrado', 'grupo_focal') then 'presencial' else 'remoto' end as area from documents where id_persona is not null)"


def _topic_facts(spark, d):
    area = F.when(F.col("source").isin("kiosco", "foro_cerrado", "grupo_focal"), "presencial").otherwise("remoto")
    return table(spark, d, "documents", "id_persona", "source").filter("id_persona is not null").select(F.col("id_persona").alias("persona"), F.col("source").alias("tema"), area.alias("area")).distinct()


@query(f"with {_TOPICS} select tema, count(distinct persona) as personas from fac group by 1")
def topic_people_counts(spark, d):
    return topics.counts_by_topic_and_area(_topic_facts(spark, d), "persona").filter("tema is not null").select("tema", "personas")


@query(f"with {_TOPICS} select area, tema, count(distinct persona) as personas from fac group by grouping sets ((area, tema), (area))")
def area_people_counts_cube(spark, d):
    return topics.counts_by_topic_and_area(_topic_facts(spark, d), "persona")


@query(f"with {_TOPICS} select persona, array_to_string(list_sort(list_distinct(list(tema))), ' | ') as temas from fac group by 1")
def topic_list_column(spark, d):
    return topics.topic_list(_topic_facts(spark, d), "persona")


@query("""with q as (select * from (values (1, 'uno'), (2, 'uno'), (2, 'dos'), (3, 'dos'), (5, 'tres')) q(encuesta_id, tema)) select id_persona, tema, count(distinct encuesta_id) as apoyos from documents join q using (encuesta_id) where id_persona is not null and text is not null group by all""")
def topic_attribution(spark, d):
    supports = spark.createDataFrame([(1, "uno"), (2, "uno"), (2, "dos"), (3, "dos"), (5, "tres")], "encuesta_id int, tema string")
    return topics.attributed(roles.answers(spark, d).filter("id_persona is not null and text is not null"), F.broadcast(supports), "encuesta_id", "id_persona")


@query("""with f as (select id_persona as persona, case when source in ('kiosco', 'foro_cerrado') then 'fusion' else source end as tema, max(encuesta_id) as ultima from documents where id_persona is not null and source is not null group by all) select * from f""")
def topics_merged(spark, d):
    facts = table(spark, d, "documents", "id_persona", "source", "encuesta_id").filter("id_persona is not null and source is not null").select(F.col("id_persona").alias("persona"), F.col("source").alias("tema"), F.col("encuesta_id").alias("ultima"))
    return topics.merged(facts, {"kiosco": "fusion", "foro_cerrado": "fusion"}, "persona", "ultima")


@query("with m as (select user_id, case when event_type in ('purchase', 'click') then -value else value end as v from events) select user_id, round(sum(v), 2) as saldo from m group by 1")
def points_balance(spark, d):
    moves = table(spark, d, "events", "user_id", "event_type", "value").withColumn("v", F.when(F.col("event_type").isin("purchase", "click"), -F.col("value")).otherwise(F.col("value")))
    return ledger.balances(moves, "user_id", "v")


@query("""with b as (select user_id, greatest(0, round(sum(case when event_type in ('purchase', 'click') then -value else value end), 2)) as saldo from events group by 1),
 l as (select user_id, event_id, value, coalesce(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as antes from events where event_type = 'signup' and value > 0)
select user_id, event_id, round(greatest(0, least(value, saldo - antes)), 2) as descuento from l join b using (user_id)""")
def points_expiry(spark, d):
    lots = table(spark, d, "events", "user_id", "event_id", "event_type", "value", "ts").filter("event_type = 'signup' and value > 0")
    balance = points_balance(spark, d).withColumn("saldo", F.greatest(F.lit(0.0), F.col("saldo")))
    return ledger.expired(lots, balance, "user_id", "value", "ts", "event_id")


# --- inbox and audit ----------------------------------------------------------------------------------------------


@query("select user_id, event_type as estado, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def inbox_latest_status(spark, d):
    events = table(spark, d, "events", "user_id", "event_type", "event_id", "ts")
    last = F.max_by(F.struct(F.col("event_type").alias("estado"), "event_id"), F.struct("ts", "event_id")).alias("x")
    return events.groupBy("user_id").agg(last).select("user_id", "x.*")


@query("select sha256(props || '|' || event_type) as huella, count(*) as recibidos, min(event_id) as primero from events group by 1")
def events_dedup(spark, d):
    body = F.sha2(F.concat("props", F.lit("|"), "event_type"), 256)
    return table(spark, d, "events", "props", "event_type", "event_id").groupBy(body.alias("huella")).agg(F.count(F.lit(1)).alias("recibidos"), F.min("event_id").alias("primero"))


@query("""with a as (select distinct id, clave, accion, actor_uid, creado_en from atributo_auditoria) select actor_uid, accion, date_trunc('month', creado_en)::date as mes, count(*) as entradas, array_to_string(list_sort(list(id)), ',') as ids from a group by all having bool_or(clave like 'deporte%')""")
def audit_events_grouped(spark, d):
    log = table(spark, d, "atributo_auditoria", "id", "clave", "accion", "actor_uid", "creado_en").dropDuplicates(["id"])
    grouped = log.groupBy("actor_uid", "accion", F.trunc("creado_en", "month").alias("mes")).agg(F.count(F.lit(1)).alias("entradas"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.bool_or(F.col("clave").startswith("deporte")).alias("toca"))
    return grouped.filter("toca").drop("toca")


@query("select (ts - interval 3 hour)::date as dia, count(*) as envios, count(*) filter (event_type = 'error') as fallidos from events group by 1")
def sends_per_local_day(spark, d):
    """Days of a zone three hours behind UTC, without daylight saving; the times have no zone."""
    day = F.to_date(F.col("ts") - F.expr("interval 3 hours"))
    return table(spark, d, "events", "ts", "event_type").groupBy(day.alias("dia")).agg(F.count(F.lit(1)).alias("envios"), F.count_if(F.col("event_type") == "error").alias("fallidos"))


@query("select event_id, user_id from events where event_type in ('error', 'view') and ts >= timestamp '2024-01-30' - interval 7 day")
def unexpired_rows(spark, d):
    """Rows kept by a time to live of seven days before a moment."""
    return table(spark, d, "events", "event_id", "user_id", "event_type", "ts").filter("event_type in ('error', 'view') and ts >= timestamp_ntz '2024-01-30 00:00:00' - interval 7 days").select("event_id", "user_id")


@query(f"""with {CUSTOMERS}, o as (select o_custkey as persona, count(*) as pedidos, round(sum(o_totalprice), 2) as total from orders group by 1) select persona, segmento, coalesce(pedidos, 0) as pedidos, coalesce(total, 0) as total from cust left join o using (persona) where region = 'ASIA'""")
def survey_list_counts(spark, d):
    counts = table(spark, d, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("persona")).agg(F.count(F.lit(1)).alias("pedidos"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = roles.customers(spark, d).filter("region = 'ASIA'").select("persona", "segmento")
    return c.join(counts, "persona", "left").select("persona", "segmento", F.coalesce("pedidos", F.lit(0)).alias("pedidos"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("""with p as (select doc_id, source, count(*) over (partition by source) as total, row_number() over (partition by source order by creado_en desc nulls last, doc_id)::int as lugar from documents where text ilike '%precio%') select * from p where lugar between 11 and 20""")
def answers_page_with_total(spark, d):
    found = roles.answers(spark, d).filter(F.col("text").ilike("%precio%"))
    totals = found.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    placed = found.select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("creado_en"), "doc_id")).alias("lugar"))
    page = placed.filter("lugar <= 20").filter("lugar >= 11")  # the limit is applied before the exchange
    return page.join(totals, page["source"].eqNullSafe(totals["source"])).select("doc_id", page["source"], "total", "lugar")


QUERIES, SQL = Q, S

