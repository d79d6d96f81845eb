"""History of changing attributes, from rows with validity and from a log of changes (problem 4).

Insert-only satellites: per entity and attribute a row is appended when the hash of the value differs from the row before
(hash-diff), and a row without hash when validity ends without a successor. Nothing is ever updated: the end of a version is the
time of the next row, a view by lead(). Attributes are split by how often they change into a slow and a fast satellite,
which are stored apart in the shared folder, so that a scan of slow attributes doesn't read the fast ones; the views read them from there.

Defined results: repeated rows count once; rows without a value, key or attribute are left out; of rows with equal beginning the
last written holds, then the one of the highest id (a null writing time counts as earliest); a validity that ends at or before
its beginning gives no version; null beginning is the earliest; an entry of the log without key or time is left out.
Groups of any size are divided into ranges (operators.sequences).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.times import micros, text_of
from cohortia.operators import skew
from cohortia.operators.sequences import RANGE, Neighbours, divided
from cohortia.session import shared_file

VALUES = ["categoria_id", "valor_num", "valor_fecha"]
FAST = 2.0  # rows with a value per entity from which an attribute's satellite is the fast one

Parts = list[tuple[DataFrame, Neighbours]]  # the usual groups and, apart from them, those divided into ranges


def holds_value() -> F.Column:
    return F.coalesce(*(F.col(v).cast("string") for v in VALUES)).isNotNull()


def hash_diff(*columns: str) -> F.Column:
    """Hash of the values; null values are told apart from any text."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns)))


def rates(rows: DataFrame, entity: str = "id_persona", attribute: str = "atributo_id", fast: float = FAST) -> DataFrame:
    """Each attribute with `satelite`: rapido with `fast` or more rows with a value per entity, else lento."""
    rate = F.count(F.lit(1)) / F.approx_count_distinct(entity, 0.02)
    return rows.filter(holds_value()).groupBy(attribute).agg(F.when(rate >= fast, "rapido").otherwise("lento").alias("satelite"))


def satellite_of_rows(rows: DataFrame, entity: str = "id_persona", attribute: str = "atributo_id", floor: int = skew.FLOOR) -> Parts:
    """Insert-only rows (entity, attribute, cambio, hash_diff, values...) from rows with desde, hasta, actualizado_en, id."""
    keys = (entity, attribute)
    held = rows.filter(holds_value() & F.col(entity).isNotNull() & F.col(attribute).isNotNull())
    held = held.select(*keys, "id", "desde", "hasta", "actualizado_en", *VALUES).withColumn("orden", micros(held, "desde"))
    return [(_appended(part, keys, near), near) for part, near in divided(held, [*keys], ("orden",), floor)]


def _appended(held: DataFrame, keys: tuple[str, str], near: Neighbours) -> DataFrame:
    # 1. the row that holds from each beginning
    last = Window.partitionBy(*near.group, "orden").orderBy(F.desc_nulls_last("actualizado_en"), F.desc("id"))
    holders = held.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n", "id", "actualizado_en")
    holders = near.lead(holders, ["desde"], "siguiente")
    holders = holders.withColumn("fin", F.least("hasta", F.col("siguiente.desde")))
    holders = holders.filter("desde is null or fin is null or fin > desde").withColumn("hash_diff", hash_diff(*VALUES))
    # 2. rows are appended where the hash changes, and where validity ends before the next row
    holders = near.lag(holders, ["hash_diff", "fin"], "anterior")
    holders = near.lead(holders.drop("siguiente"), ["desde"], "siguiente")
    same = (F.col("anterior.hash_diff") == F.col("hash_diff")) & (F.col("anterior.fin") == F.col("desde"))
    ends = F.col("fin").isNotNull() & (F.col("siguiente").isNull() | (F.col("siguiente.desde") > F.col("fin")))
    opening = F.struct(F.col("desde").alias("cambio"), F.col("orden"), F.col("hash_diff"), *VALUES)
    empty = [F.lit(None).cast(held.schema[v].dataType).alias(v) for v in VALUES]
    closing = F.struct(F.col("fin").alias("cambio"), micros(holders, "fin").alias("orden"), F.lit(None).cast("string").alias("hash_diff"), *empty)
    appended = F.array_compact(F.array(F.when(~F.coalesce(same, F.lit(False)), opening), F.when(ends, closing)))
    return holders.select(*keys, RANGE, F.explode(appended).alias("x")).select(*keys, RANGE, "x.*")


def together(parts: Parts) -> DataFrame:
    """The rows of all parts."""
    return reduce(DataFrame.unionByName, [df for df, _ in parts])


def versions(satellite: DataFrame, near: Neighbours) -> DataFrame:
    """The lead-based view: the satellite's rows with a value as versions with desde and hasta."""
    view = Neighbours(near.keys, ("orden",), near.heavy).lead(satellite, ["cambio"], "proximo")
    view = view.filter("hash_diff is not null").withColumn("desde", F.col("cambio")).withColumn("hasta", F.col("proximo.cambio"))
    return view.drop("cambio", "orden", "proximo", "hash_diff", RANGE)


def split_by_rate(satellite: DataFrame, rate: DataFrame, attribute: str = "atributo_id") -> DataFrame:
    """The satellite's rows with `satelite`. rate: a row per attribute."""
    return satellite.join(rate, attribute)


def stored(parts: Parts, rate: DataFrame, attribute: str = "atributo_id") -> dict[str, Parts]:
    """The satellites lento and rapido, written apart and read again, each in the parts given."""
    spark = rate.sparkSession
    out: dict[str, Parts] = {"lento": [], "rapido": []}
    for df, near in parts:
        folder = shared_file(spark, "satelite")
        split_by_rate(df, rate, attribute).write.partitionBy("satelite").parquet(folder)
        for name in out:
            out[name].append((spark.read.schema(df.schema).parquet(folder + f"/satelite={name}") if _exists(spark, f"{folder}/satelite={name}") else df.limit(0), near))
    return out


def _exists(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_changes(satellite: DataFrame, snapshot: DataFrame, keys: list[str], values: list[str], at: str) -> DataFrame:
    """Rows that a periodic snapshot appends to a satellite (keys, cambio, hash_diff, values): new keys and changed hashes, and
    closing rows of keys that the snapshot lacks. A snapshot row's time is its column `at`; closing rows get the latest of them."""
    latest = satellite.groupBy(*keys).agg(F.max_by("hash_diff", "cambio").alias("antes"))
    now = snapshot.select(*keys, F.col(at).alias("cambio"), hash_diff(*values).alias("hash_diff"), *values).dropDuplicates(keys)
    moment = now.agg(F.max("cambio")).scalar()
    both = now.withColumn("hay", F.lit(True)).join(latest, keys, "full")
    changed = F.when(F.col("hay"), ~F.col("hash_diff").eqNullSafe(F.col("antes"))).otherwise(F.col("antes").isNotNull())
    return both.filter(changed).select(*keys, F.coalesce(F.col("cambio"), moment).alias("cambio"), "hash_diff", *values)


def satellite_of_log(log: DataFrame, floor: int = skew.FLOOR) -> Parts:
    """Insert-only rows (clave, cambio, hash_diff, etiqueta) of the defined attributes from the log of actions."""
    in_use = F.when(F.col("accion").isin("alta", "reactivacion"), True).when(F.col("accion").isin("desactivacion", "baja"), False)
    label = F.coalesce(F.get_json_object("detalle", "$.cambios.etiqueta.despues"), F.get_json_object("detalle", "$.etiqueta"))
    entries = log.filter("clave is not null and creado_en is not null").select(
        "clave", "id", "creado_en", in_use.alias("en_uso"), F.when(F.col("accion").isin("alta", "edicion"), label).alias("etiqueta"), micros(log, "creado_en").alias("orden")
    )
    entries = entries.filter("en_uso is not null or etiqueta is not null").distinct()
    return [(_states(part, near), near) for part, near in divided(entries, ["clave"], ("orden", "id"), floor)]


def _states(entries: DataFrame, near: Neighbours) -> DataFrame:
    state = near.fill(near.fill(entries, "en_uso"), "etiqueta")
    state = near.lead(state, ["creado_en"], "siguiente")
    state = state.filter("siguiente is null or siguiente.creado_en > creado_en").drop("siguiente")  # of one moment the last holds
    state = state.withColumn("hash_diff", F.when(F.col("en_uso"), hash_diff("etiqueta")))
    state = near.lag(state, ["hash_diff"], "anterior")
    changed = ~F.col("hash_diff").eqNullSafe(F.col("anterior.hash_diff"))
    return state.filter(changed).select("clave", RANGE, F.col("creado_en").alias("cambio"), "orden", "hash_diff", "etiqueta")


def history_of_rows(rows: DataFrame, floor: int = skew.FLOOR) -> DataFrame:
    """id_persona, atributo_id, values, desde, hasta: the versions of each person's attributes, from the stored satellites."""
    satellites = stored(satellite_of_rows(rows, floor=floor), rates(rows))
    return together([(versions(df, near), near) for parts in satellites.values() for df, near in parts])


def history_of_log(log: DataFrame, floor: int = skew.FLOOR) -> DataFrame:
    """clave, etiqueta, desde, hasta: the versions of each defined attribute."""
    return together([(versions(df, near), near) for df, near in satellite_of_log(log, floor)])


def all_versions(rows: DataFrame, log: DataFrame, floor: int = skew.FLOOR) -> DataFrame:
    """entidad, atributo, desde, hasta as text, for persons and for the vocabulary (entidad catalogo)."""
    persons = history_of_rows(rows, floor).select(F.col("id_persona").alias("entidad"), F.col("atributo_id").cast("string").alias("atributo"), text_of(F.col("desde")).alias("desde"), text_of(F.col("hasta")).alias("hasta"))
    defined = history_of_log(log, floor).select(F.lit("catalogo").alias("entidad"), F.col("clave").alias("atributo"), text_of(F.col("desde")).alias("desde"), text_of(F.col("hasta")).alias("hasta"))
    return persons.unionByName(defined)
