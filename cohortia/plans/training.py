"""Queries of the general training-data operators: attributes as known at events, history of attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.operators import attribute_history as history
from cohortia.operators.known_as_of import as_known
from cohortia.sources.tables import table


def _known(spark: SparkSession, d: str, carry: tuple[str, ...] = ()) -> DataFrame:
    rows = table(spark, d, "persona_atributo").filter(history.holds_value())
    events = table(spark, d, "inscripcion", "id", "id_persona_previa", "acepto_en").withColumnRenamed("id", "inscripcion_id")
    return as_known(events, rows, "inscripcion_id", "id_persona_previa", "acepto_en", "id_persona", "atributo_id", carry=carry)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).withColumnRenamed("row_id", "persona_atributo_id")


def p2_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Registrations with the values known at their acceptance."""
    return _known(spark, d, ("categoria_id", "valor_num", "valor_fecha")).withColumnRenamed("row_id", "persona_atributo_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.all_versions(table(spark, d, "persona_atributo"), table(spark, d, "atributo_auditoria"))


def p4_satellites(spark: SparkSession, d: str) -> DataFrame:
    """The insert-only rows of persons with the satellite they belong to."""
    rows = table(spark, d, "persona_atributo")
    split = history.split_by_rate(history.together(history.satellite_of_rows(rows)), history.rates(rows))
    return split.select("id_persona", "atributo_id", "cambio", "hash_diff", "satelite", *history.VALUES)


def p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """What a monthly snapshot of the values in force appends to the satellite of the snapshot before: of two moments, the earlier one first."""
    rows = table(spark, d, "persona_atributo").filter(history.holds_value()).distinct()
    keys, out = ["id_persona", "atributo_id"], None
    for moment in ("2023-01-01", "2024-01-01"):
        at = F.lit(moment).cast("timestamp_ntz")
        held = rows.filter((F.col("desde").isNull() | (F.col("desde") <= at)) & (F.col("hasta").isNull() | (F.col("hasta") > at)) & (F.col("actualizado_en") <= at))
        snapshot = held.groupBy(*keys).agg(F.max_by(F.struct(*history.VALUES), F.struct("desde", "actualizado_en", "id")).alias("x")).select(*keys, at.alias("momento"), "x.*")
        before = out if out is not None else snapshot.limit(0).select(*keys, F.lit(None).cast("timestamp_ntz").alias("cambio"), F.lit(None).cast("string").alias("hash_diff"), *history.VALUES)
        added = history.append_changes(before, snapshot, keys, history.VALUES, "momento")
        out = added if out is None else out.unionByName(added)
    return out.select(*keys, "cambio", F.col("hash_diff").isNull().alias("cierra"), *history.VALUES)


def p4_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return history.history_of_log(table(spark, d, "atributo_auditoria")).select("clave", "etiqueta", "desde", "hasta")


QUERIES = {f.__name__: f for f in (p2_found, p2_attributes, p4_found, p4_satellites, p4_snapshots, p4_vocabulary)}

_KNOWN = """
with a as (select distinct * from persona_atributo where categoria_id is not null or valor_num is not null or valor_fecha is not null),
 i as (select distinct id as inscripcion_id, id_persona_previa as id_persona, acepto_en as t from inscripcion where id_persona_previa is not null and acepto_en is not null),
 x as (select i.*, a.id, a.atributo_id, a.hasta, a.categoria_id, a.valor_num, a.valor_fecha,
  row_number() over (partition by i.inscripcion_id, a.atributo_id order by coalesce(a.desde, timestamp '1800-01-01') desc, a.actualizado_en desc, a.id desc) as n
  from i join a using (id_persona) where coalesce(a.desde, timestamp '1800-01-01') <= t and a.actualizado_en <= t),
 y as (select * from x where n = 1 and (hasta is null or hasta > t or exists (select 1 from a b where b.id_persona = x.id_persona
  and b.atributo_id = x.atributo_id and b.desde = x.hasta and b.actualizado_en > x.t)))
"""

_VERSIONS = """
with a as (select distinct * from persona_atributo where categoria_id is not null or valor_num is not null or valor_fecha is not null),
 h as (select id_persona, atributo_id, desde, coalesce(desde, timestamp '1800-01-01') as o, hasta, concat_ws('|', coalesce(categoria_id::varchar, '-'),
  coalesce(valor_num::varchar, '-'), coalesce(valor_fecha::varchar, '-')) as v from a
  qualify row_number() over (partition by id_persona, atributo_id, desde order by actualizado_en desc nulls last, id desc) = 1),
 e as (select *, least(hasta, lead(o) over (partition by id_persona, atributo_id order by o)) as fin from h),
 k as (select *, case when v = lag(v) over w and o = lag(fin) over w then 0 else 1 end as nueva from e where fin is null or fin > o
  window w as (partition by id_persona, atributo_id order by o)),
 g as (select *, sum(nueva) over (partition by id_persona, atributo_id order by o) as g from k),
 pv as (select id_persona, atributo_id, min(desde) as desde, max_by(coalesce(fin, timestamp '9999-01-01'), o) as hasta, bool_or(desde is null) as siempre from g group by id_persona, atributo_id, g),
 l as (select distinct clave, id, creado_en, case when accion in ('alta', 'reactivacion') then 1 when accion in ('desactivacion', 'baja') then 0 end as uso,
  case when accion in ('alta', 'edicion') then coalesce(json_extract_string(detalle, '$.cambios.etiqueta.despues'), json_extract_string(detalle, '$.etiqueta')) end as et from atributo_auditoria),
 s as (select clave, id, creado_en, last_value(uso ignore nulls) over w as uso, last_value(et ignore nulls) over w as et from l
  window w as (partition by clave order by creado_en, id rows between unbounded preceding and current row)),
 s2 as (select *, case when uso = 1 then coalesce(et, '') end as estado from s qualify lead(creado_en) over (partition by clave order by creado_en, id) is distinct from creado_en),
 s3 as (select * from s2 qualify estado is distinct from lag(estado) over (partition by clave order by creado_en, id)),
 vv as (select clave, et, estado, creado_en as desde, lead(creado_en) over (partition by clave order by creado_en) as hasta from s3)
"""

SQL = {
    "p2_found": _KNOWN + "select inscripcion_id, atributo_id, id as persona_atributo_id from y",
    "p2_attributes": _KNOWN + "select inscripcion_id, atributo_id, id as persona_atributo_id, categoria_id, valor_num, valor_fecha from y",
    "p4_found": _VERSIONS
    + """select id_persona as entidad, atributo_id::varchar as atributo, case when siempre then '-' else strftime(desde, '%Y-%m-%d %H:%M:%S') end as desde,
 case when hasta = timestamp '9999-01-01' then '-' else strftime(hasta, '%Y-%m-%d %H:%M:%S') end as hasta from pv
union all select 'catalogo', clave, strftime(desde, '%Y-%m-%d %H:%M:%S'), coalesce(strftime(hasta, '%Y-%m-%d %H:%M:%S'), '-') from vv where estado is not null""",
    "p4_satellites": _VERSIONS
    + """, r as (select atributo_id, case when count(*) / count(distinct id_persona) >= 2 then 'rapido' else 'lento' end as satelite from persona_atributo
 where categoria_id is not null or valor_num is not null or valor_fecha is not null group by 1),
 y as (select id_persona, atributo_id, g, arg_min(k2, o) as k2, min(o) as o, max_by(coalesce(fin, timestamp '9999-01-01'), o) as fin from (select g.*, struct_pack(d := desde, a := categoria_id, b := valor_num, c := valor_fecha) as k2
  from g join (select distinct id_persona, atributo_id, desde, categoria_id, valor_num, valor_fecha, actualizado_en, id from a
   qualify row_number() over (partition by id_persona, atributo_id, desde order by actualizado_en desc nulls last, id desc) = 1) z using (id_persona, atributo_id, desde)
  union all select g.*, struct_pack(d := desde, a := categoria_id, b := valor_num, c := valor_fecha) from g join (select distinct id_persona, atributo_id, categoria_id, valor_num, valor_fecha, actualizado_en, id from a where desde is null
   qualify row_number() over (partition by id_persona, atributo_id order by actualizado_en desc nulls last, id desc) = 1) z using (id_persona, atributo_id) where g.desde is null) group by all),
 c as (select *, lead(o) over (partition by id_persona, atributo_id order by o) as prox from y),
 u as (select id_persona, atributo_id, k2.d as cambio, md5(concat_ws('|', coalesce('=' || k2.a::varchar, '-'), coalesce('=' || k2.b::varchar, '-'), coalesce('=' || k2.c::varchar, '-'))) as hash_diff, k2.a as categoria_id, k2.b as valor_num, k2.c as valor_fecha from c
  union all select id_persona, atributo_id, fin, null, null, null, null from c where fin < timestamp '9999-01-01' and (prox is null or prox > fin))
select u.*, satelite from u join r using (atributo_id)""",
    "p4_snapshots": """
with a as (select distinct * from persona_atributo where categoria_id is not null or valor_num is not null or valor_fecha is not null),
 f as (select m, id_persona, atributo_id, categoria_id, valor_num, valor_fecha from a, (values (timestamp '2023-01-01'), (timestamp '2024-01-01')) t(m)
  where (desde is null or desde <= m) and (hasta is null or hasta > m) and actualizado_en <= m qualify row_number() over (partition by m, id_persona, atributo_id order by desde desc nulls last, actualizado_en desc, id desc) = 1),
 p as (select * from f where m = timestamp '2023-01-01'), q as (select * from f where m = timestamp '2024-01-01')
select id_persona, atributo_id, m as cambio, false as cierra, categoria_id, valor_num, valor_fecha from p
union all select q.id_persona, q.atributo_id, q.m, false, q.categoria_id, q.valor_num, q.valor_fecha from q left join p using (id_persona, atributo_id)
 where p.m is null or p.categoria_id is distinct from q.categoria_id or p.valor_num is distinct from q.valor_num or p.valor_fecha is distinct from q.valor_fecha
union all select id_persona, atributo_id, timestamp '2024-01-01', true, null, null, null from p left join q using (id_persona, atributo_id) where q.m is null""",
    "p4_vocabulary": _VERSIONS + "select clave, et as etiqueta, desde, hasta from vv where estado is not null",
}
