"""Queries of segments, composition, participation and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortia.functions.criteria import Criterion, normalise
from cohortia.functions.expressions import lacks_letters, lacks_letters_and_digits, phone_key, whole_days
from cohortia.operators import composition, participation, sampling, segments
from cohortia.plans import roles
from cohortia.plans.roles import ACTIVE, CUSTOMERS, DEMO, NOW, PART, POP, SQL_NOW, TARGETS
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


DIMENSIONS = ["sexo", "localidad", "tramo_etario", "edad"]


def _criteria(*raw: dict) -> list[Criterion]:
    return [normalise(r, DIMENSIONS, ["edad"]) for r in raw]


@query(f"""with {DEMO}, seg as (select distinct p.id_persona from persona p join demo d using (id_persona) where d.sexo = 'F' and d.edad >= 30
  and exists (select 1 from membresia m where m.id_persona = p.id_persona and m.estado = 'activo'))
select id_persona, row_number() over (order by md5(id_persona || 'semilla-1'), id_persona)::int as lugar from seg order by 2 limit 100""")
def segment_seeded_sample(spark, d):
    people = segments.matching(roles.people(spark, d).select("id_persona"), roles.attribute_values(spark, d), _criteria({"dimension": "sexo", "operador": "eq", "valor": "F"}, {"dimension": "edad", "operador": "gte", "valor": 30}))
    return segments.drawn(segments.related(people, roles.active(spark, d), "id_persona"), "id_persona", "semilla-1", 100)


@query(f"""with {DEMO}, seg as (select distinct p.id_persona from persona p join demo d using (id_persona) where d.sexo = 'F')
select id_persona, row_number() over (order by md5(id_persona || 'semilla-2'), id_persona)::int as lugar from seg order by 2 limit 20 offset 40""")
def segment_page(spark, d):
    people = segments.matching(roles.people(spark, d).select("id_persona"), roles.attribute_values(spark, d), _criteria({"dimension": "sexo", "operador": "eq", "valor": "F"}))
    return segments.drawn(people, "id_persona", "semilla-2", 20, 40)


@query(f"with {DEMO} select id_persona, sexo, tramo_etario from demo where localidad not in ('villa_cendal', 'san_aurelio') and sexo <> 'M'")
def segment_not_in_excludes_missing(spark, d):
    criteria = _criteria({"dimension": "localidad", "operador": "not_in", "valor": ["villa_cendal", "san_aurelio"]}, {"dimension": "sexo", "operador": "ne", "valor": "M"})
    people = roles.demographics(spark, d).select("id_persona", "sexo", "tramo_etario")
    return segments.matching(people, roles.attribute_values(spark, d), criteria)


@query(f"with {DEMO} select id_persona, localidad, edad from demo where localidad ilike '%VILLA%' and edad < 40")
def segment_contains(spark, d):
    criteria = _criteria({"dimension": "localidad", "operador": "contiene", "valor": "VILLA"}, {"dimension": "edad", "operador": "lt", "valor": 40})
    return segments.matching(roles.demographics(spark, d).select("id_persona", "localidad", "edad"), roles.attribute_values(spark, d), criteria)


def _catalogue(spark, d):
    from cohortia.functions.criteria import from_catalogue

    return from_catalogue({"sexo": {"en": ["F", "X"]}, "edad": {"min": 25.0, "max": 44.0}}, {"sexo": "categorico", "edad": "derivado"})


@query(f"with {DEMO} select id_persona from demo where sexo in ('F', 'X') and edad >= 25 and edad <= 44")
def segment_by_catalogue_filter(spark, d):
    return segments.matching(roles.demographics(spark, d).select("id_persona"), roles.attribute_values(spark, d), _catalogue(spark, d))


@query(f"""with {PART}, {CUSTOMERS}, h as (select persona, count(*) as n from part where convocado_en >= timestamp '1998-01-01' group by 1)
select persona, segmento from cust left join h using (persona) where coalesce(n, 0) >= 3 and region = 'EUROPE'""")
def segment_history_at_least_k(spark, d):
    recent = roles.participation(spark, d).filter("convocado_en >= timestamp_ntz '1998-01-01 00:00:00'")
    people = roles.customers(spark, d).filter("region = 'EUROPE'").select("persona", "segmento")
    return segments.with_history(people, recent, "persona", 3)


@query(f"""with {PART}, {CUSTOMERS}, h as (select persona, count(*) as n from part where respondio and ola between 1996 and 1999 group by 1)
select persona from cust left join h using (persona) where coalesce(n, 0) < 2""")
def segment_history_fewer_than_k(spark, d):
    answered = roles.participation(spark, d).filter("respondio and ola between 1996 and 1999")
    return segments.with_history(roles.customers(spark, d).select("persona"), answered, "persona", 2, at_least=False)


@query(f"with {PART}, {CUSTOMERS} select persona, pais from cust where persona not in (select persona from part where ola = 2000)")
def segment_without_wave(spark, d):
    return segments.related(roles.customers(spark, d).select("persona", "pais"), roles.participation(spark, d).filter("ola = 2000"), "persona", has=False)


@query("""with p as (select distinct on (id_persona) * from persona), i as (select distinct id_persona, nombre as alias from inscripcion where id_persona is not null)
select id_persona, nombre from p where coalesce(contains(strip_accents(lower(nombre)), 'gorriquel'), false) or coalesce(contains(strip_accents(lower(email)), 'gorriquel'), false)
 or exists (select 1 from i where i.id_persona = p.id_persona and contains(strip_accents(lower(alias)), 'gorriquel'))""")
def people_named_like(spark, d):
    aliases = table(spark, d, "inscripcion", "id_persona", "nombre").filter("id_persona is not null").withColumnRenamed("nombre", "alias")
    return segments.named_like(roles.people(spark, d), aliases, "Gorríquel", ["nombre", "email"]).select("id_persona", "nombre")


@query("""with p as (select distinct on (id_persona) * from persona),
 f as (select id_persona, list_filter([case when trim(nombre) <> '' and not regexp_matches(nombre, '[A-Za-zÀ-ÖØ-öø-ÿ]') then 'nombre' end,
  case when trim(documento) <> '' and not regexp_matches(documento, '[0-9A-Za-zÀ-ÖØ-öø-ÿ]') then 'documento' end,
  case when trim(celular) <> '' and not regexp_matches(celular, '[0-9]{8}') then 'celular' end], lambda x: x is not null) as campos from p)
select id_persona, array_to_string(campos, ',') as campos from f where len(campos) > 0""")
def garbage_identifiers(spark, d):
    p = roles.people(spark, d)
    bad = [F.when(lacks_letters(F.col("nombre")), "nombre"), F.when(lacks_letters_and_digits(F.col("documento")), "documento")] + [F.when((F.trim("celular") != "") & ~F.col("celular").rlike("[0-9]{8}"), "celular")]
    fields = F.array_compact(F.array(*bad))
    return p.select("id_persona", F.array_join(fields, ",").alias("campos")).filter("campos <> ''")


@query("""with p as (select distinct id_persona, celular from persona), n as (select id_persona, regexp_replace(trim(celular), '^00', '+') as m from p),
 g as (select id_persona, m, regexp_replace(m, '[^0-9]', '', 'g') as g from n),
 w as (select id_persona, g, case when starts_with(m, '+') or (starts_with(g, '598') and length(g) > 3) then g else '598' || ltrim(g, '0') end as w from g)
select id_persona, case when length(g) > 0 and length(w) between 8 and 15 then '+' || w end as celular from w""")
def normalised_phones(spark, d):
    return roles.people(spark, d).select("id_persona", phone_key(F.col("celular")).alias("celular"))


@query("""with a as (select distinct * from persona_atributo where (categoria_id is not null or valor_num is not null or valor_fecha is not null)
  and (desde is null or desde <= timestamp '2025-01-01') and (hasta is null or hasta > timestamp '2025-01-01'))
select a.id_persona, a.atributo_id, coalesce(c.clave, a.valor_num::decimal(20,2)::varchar, a.valor_fecha::varchar) as valor, a.valor_num
from (select * from a qualify row_number() over (partition by id_persona, atributo_id order by desde desc nulls last, actualizado_en desc, id desc) = 1) a
left join atributo_categoria c on c.id = a.categoria_id""")
def attr_point_in_time(spark, d):
    return segments.attribute_values(table(spark, d, "persona_atributo"), table(spark, d, "atributo_categoria"), F.expr("timestamp_ntz '2025-01-01 00:00:00'"))


@query("""with p as (select distinct id_persona, fecha_nacimiento as b from persona where fecha_nacimiento is not null),
 a as (select id_persona, (2025 - year(b) - (case when '0228' < strftime(b, '%m%d') then 1 else 0 end))::int as edad from p)
select id_persona, edad, case when edad < 18 then '<18' when edad < 25 then '18-24' when edad < 35 then '25-34' when edad < 45 then '35-44'
 when edad < 55 then '45-54' when edad < 65 then '55-64' else '65+' end as tramo_etario from a""")
def derived_age(spark, d):
    return segments.derived_age(roles.people(spark, d), F.to_date(F.lit("2025-02-28")))


_COUNTS = """cnt as (select panel_id, dimension, coalesce(categoria, '(sin dato)') as categoria, count(*) as n from (
  select panel_id, 'sexo' as dimension, sexo as categoria from pop union all select panel_id, 'tramo_etario', tramo_etario from pop union all select panel_id, 'localidad', localidad from pop) group by all)"""
_GAP = f"""with {POP}, {TARGETS}, {_COUNTS},
 j as (select panel_id, dimension, categoria, coalesce(n, 0) as n, proporcion from cnt full join obj using (panel_id, dimension, categoria)),
 w as (select *, sum(case when categoria <> '(sin dato)' then n else 0 end) over (partition by panel_id, dimension)::bigint as con_dato, sum(n) over (partition by panel_id, dimension)::bigint as total from j),
 g as (select panel_id, dimension, categoria, n, proporcion, con_dato, total, case when con_dato > 0 then round(n / con_dato, 4) else 0.0 end as actual, round_even(proporcion * total, 0)::bigint as esperados from w where categoria <> '(sin dato)'),
 r as (select *, round(actual - proporcion, 4) as brecha, greatest(0, esperados - n) as faltan, greatest(0, n - esperados) as sobran from g)"""


def _gap(spark, d):
    counts = composition.observed(roles.population(spark, d), ["panel_id"], ["sexo", "tramo_etario", "localidad"])
    return composition.against_targets(counts, roles.targets(spark, d).select("panel_id", "dimension", "categoria", "proporcion"), ["panel_id"])


@query(_GAP + " select panel_id, dimension, categoria, n, con_dato, total, actual, brecha, case when proporcion is null then null else esperados end as esperados, case when proporcion is null then 0 else faltan end as faltan, case when proporcion is null then 0 else sobran end as sobran from r")
def composition_gap(spark, d):
    g = _gap(spark, d).select("panel_id", "dimension", "categoria", "n", "con_dato", "total", "actual", "brecha", "esperados", "faltan", "sobran")
    return g.withColumn("faltan", F.coalesce("faltan", F.lit(0))).withColumn("sobran", F.when(F.col("esperados").isNull(), 0).otherwise(F.col("sobran")))


@query(_GAP + " select panel_id, dimension, ((sum(round(abs(coalesce(brecha, 0)) * 10000)::bigint)::bigint + 1) // 2) / 10000 as disimilitud from r group by all")
def composition_dissimilarity(spark, d):
    return composition.dissimilarity(_gap(spark, d), ["panel_id"])


@query(f"""with {DEMO}, c as (select sexo, tramo_etario, count(*) as n from demo where sexo is not null and tramo_etario is not null group by all),
 t as (select *, sum(n) over (partition by sexo) as f, sum(n) over (partition by tramo_etario)::bigint as base, sum(n) over () as e from c)
select sexo, tramo_etario, n, round(n / f, 4) as pct_fila, round(n / base, 4) as pct_columna, round(n / e, 4) as pct_total, base, base < 30 as base_chica from t""")
def crosstab_pct(spark, d):
    return composition.cross_table(roles.demographics(spark, d), "sexo", "tramo_etario")


@query(f"""with {DEMO} select tramo_etario, count(*) filter (sexo = 'F') as "F", count(*) filter (sexo = 'M') as "M", count(*) filter (sexo = 'X') as "X" from demo where tramo_etario is not null group by 1""")
def crosstab_matrix(spark, d):
    return composition.cross_matrix(roles.demographics(spark, d), "tramo_etario", "sexo", ["F", "M", "X"])


@query(f"""with {PART}, {CUSTOMERS} select segmento as categoria, count(*) as convocados, count(*) filter (respondio) as respondieron,
 round(count(*) filter (respondio) / count(*), 4) as tasa from part join cust using (persona) where ola = 1999 group by 1""")
def response_rate_by_segment(spark, d):
    facts = roles.participation(spark, d).filter("ola = 1999").join(roles.customers(spark, d), "persona")
    return composition.response_by_category(facts, "segmento", F.lit(True), F.col("respondio"))


@query(f"""with {TARGETS} select panel_id, dimension, round(sum(proporcion), 6) as suma, min(proporcion) as menor, max(proporcion) as mayor from obj group by all
having abs(round(sum(proporcion), 6) - 1) > 0.005 or min(proporcion) < 0 or max(proporcion) > 1""")
def invalid_targets(spark, d):
    return composition.invalid_targets(roles.targets(spark, d), ["panel_id"])


@query(f"""with {PART} select ola, count(*) as convocados, count(*) filter (respondio) as respondieron, count(*) filter (calidad = 'sospechoso') as sospechosos,
 min(convocado_en) as primero, max(convocado_en) as ultimo, round(count(*) filter (respondio) / count(*), 4) as tasa from part group by 1""")
def wave_kpis(spark, d):
    return participation.by_wave(roles.participation(spark, d))


_PROFILE = f"""{PART}, {CUSTOMERS}, prof as (select persona, count(p.persona2) as convocatorias, count(*) filter (respondio) as respuestas, max(convocado_en) as ultimo_contacto
  from cust left join (select persona as persona2, * exclude (persona) from part) p on p.persona2 = persona group by 1)"""


def _profiles(spark, d):
    return participation.profiles(roles.customers(spark, d).select("persona"), roles.participation(spark, d))


@query(f"with {_PROFILE} select * from prof")
def participation_profile(spark, d):
    return _profiles(spark, d)


@query(f"""with {_PROFILE}, x as (select *, floor(epoch({SQL_NOW} - ultimo_contacto) / 86400) as dias from prof)
select case when dias is null then 'nunca' when dias <= 30 then 'hasta_30_dias' when dias <= 90 then '31_a_90_dias' when dias <= 180 then '91_a_180_dias' else 'mas_de_180_dias' end as recencia,
 case when convocatorias >= 5 then '5_o_mas' else convocatorias::varchar end as llamados, count(*) as personas from x group by all""")
def recency_bands(spark, d):
    return participation.recency(_profiles(spark, d), F.expr(NOW))


@query(f"""with {_PROFILE}, o as (select *, row_number() over (order by convocatorias desc, persona) as k, count(*) over () as n from prof),
 h as (select greatest(1, round_even(0.1 * max(n), 0))::bigint as cabeza from o)
select cabeza, sum(case when k <= cabeza then convocatorias else 0 end)::bigint as llamados, sum(convocatorias)::bigint as total,
 round(sum(case when k <= cabeza then convocatorias else 0 end) / sum(convocatorias), 4) as proporcion from o, h group by cabeza""")
def call_concentration_top_decile(spark, d):
    return participation.concentration(_profiles(spark, d))


@query(f"""with {PART}, {CUSTOMERS}, x as (select segmento, datediff('day', lag(convocado_en::date) over (partition by persona order by ola), convocado_en::date) as dias from part join cust using (persona)),
 y as (select segmento, dias, row_number() over (partition by segmento order by dias) - 1 as k, count(*) over (partition by segmento) as n from x where dias is not null)
select segmento, dias::int as mediana from y where k = n // 2""")
def upper_median_days(spark, d):
    from cohortia.operators.longitudinal import timeline

    facts = timeline(roles.participation(spark, d), "persona", "convocado_en", "ola").join(roles.customers(spark, d).select("persona", "segmento"), "persona")
    return participation.upper_median(facts, "dias", ["segmento"])


@query(f"""with {PART} select persona, count(*) filter (convocado_en >= {SQL_NOW} - interval 90 day) as recientes, count(*) as totales, count(*) filter (respondio) as respondidas, max(convocado_en) as ultima from part group by 1""")
def fatigue_by_person(spark, d):
    return participation.fatigue(roles.participation(spark, d), F.expr(NOW))


@query(f"with {_PROFILE} select persona, convocatorias, row_number() over (order by convocatorias desc, persona)::int as puesto from prof qualify puesto <= 15")
def most_called(spark, d):
    top = _profiles(spark, d).select("persona", "convocatorias").orderBy(F.desc("convocatorias"), "persona").limit(15)
    return top.withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("convocatorias"), "persona")))


_CAND = f"""{PART}, {CUSTOMERS}, f as (select persona, count(*) filter (convocado_en >= {SQL_NOW} - interval 730 day) as recientes, count(*) as totales, count(*) filter (respondio) as respondidas,
  max(convocado_en) as ultima, bool_or(ola = 2001) as ya from part group by 1),
 cand as (select persona, segmento as categoria, coalesce(recientes, 0) as recientes, coalesce(totales, 0) as totales, coalesce(respondidas, 0) as respondidas, floor(epoch({SQL_NOW} - ultima) / 86400)::bigint as dias, coalesce(ya, false) as ya from cust left join f using (persona)),
 ex as (select *, case when ya then 'ya_en_encuesta' when recientes >= 2 then 'tope_ventana' when totales >= 6 then 'tope_total' when dias < 300 then 'muy_reciente' end as motivo from cand),
 eleg as (select * from ex where motivo is null)"""


def _candidates(spark, d):
    facts = roles.participation(spark, d)
    counts = participation.fatigue(facts, F.expr(NOW), 730).join(facts.groupBy("persona").agg(F.bool_or(F.col("ola") == 2001).alias("ya")), "persona")
    joined = roles.customers(spark, d).select("persona", F.col("segmento").alias("categoria")).join(counts, "persona", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("recientes", "totales", "respondidas")}
    candidates = joined.withColumns({**zero, "ya": F.coalesce("ya", F.lit(False)), "dias": whole_days(F.expr(NOW), F.col("ultima"))}).drop("ultima")
    return sampling.exclusions(candidates, sampling.Limits(2, 6, 300))


@query(f"with {_CAND} select * from ex")
def sampling_exclusion_reasons(spark, d):
    return _candidates(spark, d)


_MISSING = """mis as (select categoria, count(*) filter (totales < 6) as faltan from cand group by 1),
 quo as (select categoria, faltan, round_even(40 * faltan / sum(faltan) over (), 0)::bigint as cupo from mis where faltan > 0)"""


def _quota(spark, d):
    missing = _candidates(spark, d).groupBy("categoria").agg(F.count_if(F.col("totales") < 6).alias("faltan"))
    return sampling.quotas(missing, 40)


_RULES = """o as (select e.*, faltan, cupo, row_number() over (partition by e.categoria order by recientes, totales, respondidas desc, persona)::int as orden from eleg e join quo using (categoria)),
 rules as (select persona, categoria, orden, orden > cupo as completa from o order by orden > cupo, case when orden <= cupo then -faltan end, case when orden <= cupo then categoria end,
  case when orden <= cupo then orden end, recientes, totales, respondidas desc, persona limit 40)"""


@query(f"with {_CAND}, {_MISSING}, {_RULES} select persona, categoria, orden, completa from rules")
def quota_rule_sample(spark, d):
    eligible = _candidates(spark, d).filter("motivo is null")
    return sampling.by_quota(eligible, _quota(spark, d), "persona", 40).select("persona", "categoria", "orden", "completa")


@query(f"""with {_CAND}, c as (select distinct categoria from cand), quo as (select categoria, 0 as faltan, 40 // count(*) over () as cupo from c), {_RULES} select persona, categoria, orden, completa from rules""")
def even_rule_sample(spark, d):
    candidates = _candidates(spark, d)
    quota = sampling.even_quotas(candidates.select("categoria").distinct(), 40)
    return sampling.by_quota(candidates.filter("motivo is null"), quota, "persona", 40).select("persona", "categoria", "orden", "completa")


@query(f"""with {_CAND}, m as (select categoria, count(*) filter (totales < 6) as faltan from cand group by 1), quo as (select categoria, faltan, round_even(4000 * faltan / sum(faltan) over (), 0)::bigint as cupo from m where faltan > 0)
select categoria, faltan, cupo, count(persona) as elegibles from quo left join eleg using (categoria) group by all having count(persona) < cupo""")
def quota_shortfalls(spark, d):
    candidates = _candidates(spark, d)
    missing = candidates.groupBy("categoria").agg(F.count_if(F.col("totales") < 6).alias("faltan"))
    return sampling.shortfalls(candidates.filter("motivo is null"), sampling.quotas(missing, 4000))


@query(f"""with {_CAND}, t as (select distinct categoria, 250 as meta from cand), tp as (select unnest([2, 3, 4, 5]) as tope),
 n as (select tope, t.categoria, t.meta, (select count(*) from cand c where c.categoria = t.categoria and not ya and recientes < tope and totales < 6 and not coalesce(dias < 300, false)) as n from tp, t),
 x as (select *, least(n, meta) as tomadas, sum(least(n, meta)) over (partition by tope) as total from n),
 b as (select tope, sum(n)::bigint as elegibles, sum(tomadas)::bigint as tamano, round(sum(abs(tomadas / greatest(total, 1) - meta / 1250)) / 2, 4) as disimilitud, sum(tomadas) >= least(sum(meta), 1250) as alcanza from x group by 1),
 y as (select *, coalesce(max(case when alcanza or (tope > 2 and elegibles = (select elegibles from b where tope = 2)) then 1 else 0 end) over (order by tope rows between unbounded preceding and 1 preceding), 0) as antes from b),
 z as (select *, unnest(case when tope > 2 then ['aflojar_la_fatiga'] when alcanza then ['factible'] else ['reducir_el_tamano', 'aceptar_la_brecha'] end) as opcion from y where antes = 0)
select opcion, tope, elegibles, tamano, disimilitud, alcanza from z""")
def optimizer_alternatives(spark, d):
    candidates = _candidates(spark, d).drop("motivo")
    targets = candidates.select("categoria").distinct().withColumn("meta", F.lit(250))
    return sampling.alternatives(candidates, targets, 1250, sampling.Limits(2, 6, 300))


_OPT = f"""{_CAND}, meta as (select categoria, 12 as meta from cand group by 1), m as (select avg(totales) as media from eleg),
 c as (select e.*, meta, round(1.0 * least(1.0, recientes / 3) + 0.5 * totales / (1 + media), 12) as costo from eleg e join meta using (categoria), m),
 k as (select *, row_number() over (partition by categoria order by costo, recientes, totales, respondidas desc, persona desc)::int as k from c),
 s as (select *, round(10.0 * (2 * (meta - k + 1) - 1) / 40 - costo, 12) as puntaje from k where k <= least(meta, 40)),
 opt as (select persona, categoria, k, puntaje from s order by puntaje desc, recientes, totales, respondidas desc, persona desc limit 40)"""


def _optimised(spark, d):
    candidates = _candidates(spark, d)
    targets = candidates.select("categoria").distinct().withColumn("meta", F.lit(12))
    return sampling.optimised(candidates.filter("motivo is null"), targets, 40, "persona")


@query(f"with {_OPT} select persona, categoria, k, round(puntaje, 6) as puntaje from opt")
def optimizer_selection(spark, d):
    return _optimised(spark, d).withColumn("puntaje", F.round("puntaje", 6))


@query(f"""with {_OPT}, {_MISSING}, {_RULES}, r as (select persona from rules)
select count(*) filter (opt.persona is not null and r.persona is not null) as ambos, count(*) filter (r.persona is null) as solo_a, count(*) filter (opt.persona is null) as solo_b from opt full join r on opt.persona = r.persona""")
def optimizer_versus_rules(spark, d):
    return sampling.overlap(_optimised(spark, d), quota_rule_sample(spark, d), "persona")


@query(f"""with {PART} select ola, count(*) as personas, count(*) filter (not respondio) as sin_responder from part where convocado_en >= timestamp '1996-03-01' and convocado_en < timestamp '1997-04-01' group by 1""")
def audience_by_dates(spark, d):
    inside = roles.participation(spark, d).filter("convocado_en >= timestamp_ntz '1996-03-01 00:00:00' and convocado_en < timestamp_ntz '1997-04-01 00:00:00'")
    return inside.groupBy("ola").agg(F.count(F.lit(1)).alias("personas"), F.count_if(~F.col("respondio")).alias("sin_responder"))


@query(f"""with {ACTIVE}, p as (select distinct id_persona, documento, email, celular, creado_en from persona)
select count(*) as total, count(*) filter (documento is null) as sin_documento, count(*) filter (email is null and celular is null) as sin_contacto,
 count(*) filter (not exists (select 1 from act where act.id_persona = p.id_persona)) as sin_panel from p""")
def people_statistics(spark, d):
    member = roles.active(spark, d).select("id_persona").distinct().withColumn("m", F.lit(True))
    p = roles.people(spark, d).join(member, "id_persona", "left")
    no_contact = F.col("email").isNull() & F.col("celular").isNull()
    return p.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("documento").isNull()).alias("sin_documento"), F.count_if(no_contact).alias("sin_contacto"), F.count_if(F.col("m").isNull()).alias("sin_panel"))


@query("""with p as (select distinct id_persona, creado_en from persona) select date_trunc('month', creado_en)::date as mes, count(*) as altas from p where creado_en is not null group by 1 order by 1 desc limit 12""")
def monthly_enrolments(spark, d):
    months = roles.people(spark, d).filter("creado_en is not null").groupBy(F.trunc("creado_en", "month").alias("mes")).agg(F.count(F.lit(1)).alias("altas"))
    return months.orderBy(F.desc("mes")).limit(12)


@query(f"""with {ACTIVE}, p as (select distinct id_persona from persona) select (select count(*) from p where id_persona not in (select id_persona from act)) as solo_personas,
 (select count(distinct id_persona) from act where id_persona not in (select id_persona from p)) as solo_membresias, (select count(*) from p where id_persona in (select id_persona from act)) as ambos""")
def cross_store_gap(spark, d):
    p = roles.people(spark, d).select("id_persona", F.lit(1).alias("p"))
    m = roles.active(spark, d).select("id_persona").distinct().withColumn("m", F.lit(1))
    both = p.join(m, "id_persona", "full")
    return both.agg(F.count_if(F.col("m").isNull()).alias("solo_personas"), F.count_if(F.col("p").isNull()).alias("solo_membresias"), F.count_if(F.col("p").isNotNull() & F.col("m").isNotNull()).alias("ambos"))


@query("""with i as (select distinct id, id_persona, finalidades from inscripcion), x as (select id, id_persona, unnest(finalidades) as finalidad from i)
select finalidad, count(*) as registros, count(distinct id_persona) as personas from x where finalidad is not null group by 1""")
def consents_by_purpose(spark, d):
    entries = table(spark, d, "inscripcion", "id", "id_persona", "finalidades").dropDuplicates(["id"])
    each = entries.select("id", "id_persona", F.explode("finalidades").alias("finalidad")).filter("finalidad is not null")
    return each.groupBy("finalidad").agg(F.count(F.lit(1)).alias("registros"), F.count_distinct("id_persona").alias("personas"))


@query(f"""with {DEMO}, i as (select distinct id_persona from inscripcion where id_persona is not null and list_contains(finalidades, 'contacto_participacion')) select sexo, id_persona in (select id_persona from i) as habilitada, count(*) as personas from demo group by all""")
def consent_gate_split(spark, d):
    gate = table(spark, d, "inscripcion", "id_persona", "finalidades").filter("id_persona is not null and array_contains(finalidades, 'contacto_participacion')").select("id_persona").distinct()
    marked = roles.demographics(spark, d).join(gate.withColumn("g", F.lit(True)), "id_persona", "left")
    return marked.groupBy("sexo", F.col("g").isNotNull().alias("habilitada")).agg(F.count(F.lit(1)).alias("personas"))


QUERIES, SQL = Q, S
