"""Recognition of people by identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.expressions import fold, phone_key


def owners(people: DataFrame, key: Column, person: str = "id_persona") -> DataFrame:
    """(clave, duenos, persona) of a normalised identifier: how many people have it and the first of them."""
    return people.select(key.alias("clave"), F.col(person).alias("p")).filter("clave is not null and clave <> ''").groupBy("clave").agg(F.count_distinct("p").alias("duenos"), F.min("p").alias("persona"))


def resolve(values: DataFrame, owned: DataFrame, key: Column, unique: bool = True) -> DataFrame:
    """values with persona and motivo: vacio, desconocido, ambiguo (several owners, where one is required), or null if resolved."""
    joined = values.withColumn("clave", key).join(owned, "clave", "left")
    reason = F.when(F.col("clave").isNull() | (F.col("clave") == ""), "vacio").when(F.col("duenos").isNull(), "desconocido")
    if unique:
        reason = reason.when(F.col("duenos") > 1, "ambiguo")
    return joined.withColumn("motivo", reason).withColumn("persona", F.when(F.col("motivo").isNull(), F.col("persona"))).drop("clave", "duenos")


def name_set(name: Column) -> Column:
    """Sorted distinct words of a folded name."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.regexp_replace(fold(name), "[^a-z0-9]+", " "), " "), "")))


def compatible_names(a: Column, b: Column) -> Column:
    """One name's words are among the other's, or a name is missing."""
    x, y = name_set(F.coalesce(a, F.lit(""))), name_set(F.coalesce(b, F.lit("")))
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def decide(entries: DataFrame, people: DataFrame, entry: str = "id") -> DataFrame:
    """(entry, decision, persona, regla) of each new entry by the first rule that decides.

    document equal: reuse; mail equal: reuse; phone: of the owners who don't contradict by document or mail, none: go on, the
    only owner with a compatible name: reuse, else review; without document and mail, name and birth date equal: review; else create.

    People are aggregated once, a row per identifier; entries meet them in one join and come together again. A phone of any number of owners is one
    row: where neither document nor mail decides, an owner contradicts exactly if both sides have the one or the other.
    """

    def keyed(df: DataFrame, key: str) -> DataFrame:
        mail = F.nullif(F.lower(F.trim("email")), F.lit(""))
        named = F.when(F.col("nombre").isNotNull() & F.col("fecha_nacimiento").isNotNull(), F.concat_ws("|", F.lower("nombre"), F.col("fecha_nacimiento").cast("string")))
        given = {"documento": F.nullif("documento", F.lit("")), "email": mail, "celular": phone_key(F.col("celular")), "nombre_fecha": named}
        ids = F.array(*(F.struct(F.lit(k).alias("tipo"), v.alias("valor")) for k, v in given.items()))
        return df.select(F.col(key).alias("e"), "nombre", F.col("documento").isNull().alias("sin_d"), F.lower(F.trim("email")).isNull().alias("sin_m"), F.explode(ids).alias("x")).select("e", "nombre", "sin_d", "sin_m", "x.*")

    owned = keyed(people, "id_persona").filter("valor is not null").groupBy("tipo", "valor").agg(
        F.min("e").alias("primera"), F.max("e").alias("ultima"), F.min_by("nombre", "e").alias("n2"), F.bool_or("sin_d").alias("algun_sin_d"), F.bool_or("sin_m").alias("algun_sin_m"), F.bool_or(F.col("sin_d") & F.col("sin_m")).alias("alguno_sin")
    )
    met = keyed(entries, entry).join(owned, ["tipo", "valor"], "left")
    phone = F.col("tipo") == "celular"
    possible = F.when(F.col("sin_d") & F.col("sin_m"), True).when(F.col("sin_d"), F.col("algun_sin_m")).when(F.col("sin_m"), F.col("algun_sin_d")).otherwise(F.col("alguno_sin"))
    alone = F.when(phone & (F.col("primera") == F.col("ultima")), compatible_names(F.col("nombre"), F.col("n2")))  # names are read for phones of one owner only
    of = lambda kind: F.max(F.when(F.col("tipo") == kind, F.col("primera"))).alias(f"p_{kind}")
    flag = lambda c, name: F.coalesce(F.bool_or(phone & F.col("primera").isNotNull() & c), F.lit(False)).alias(name)
    joined = met.groupBy("e").agg(*(of(k) for k in ("documento", "email", "celular", "nombre_fecha")), flag(possible, "posible"), flag(possible & alone, "sola"), F.bool_and(F.col("sin_d") & F.col("sin_m")).alias("sin_nada"))
    rule = (
        F.when(F.col("p_documento").isNotNull(), "documento")
        .when(F.col("p_email").isNotNull(), "email")
        .when(F.col("posible"), F.when(F.col("sola"), "celular").otherwise("celular_dudoso"))
        .when(F.col("sin_nada") & F.col("p_nombre_fecha").isNotNull(), "nombre_fecha")
        .otherwise("ninguna")
    )
    decision = F.when(F.col("regla").isin("documento", "email", "celular"), "reutiliza").when(F.col("regla") == "ninguna", "crea").otherwise("revision")
    chosen = F.when(F.col("regla") == "documento", F.col("p_documento")).when(F.col("regla") == "email", F.col("p_email")).when(F.col("regla") == "celular", F.col("p_celular")).when(F.col("regla") == "nombre_fecha", F.col("p_nombre_fecha"))
    return joined.withColumn("regla", rule).select(F.col("e").alias(entry), decision.alias("decision"), chosen.alias("persona"), "regla")


def resolve_typed(values: DataFrame, people: DataFrame, aliases: DataFrame, kind: str = "tipo", value: str = "valor") -> DataFrame:
    """values with persona and motivo, each by its kind: uuid, alias (within its origen), documento, email (lower case), celular (only one owner).

    people: id_persona, documento, email, celular; aliases: origen, alias, id_persona. values: kind, value, origen. One join, a row per identifier;
    motivo: tipo_desconocido, vacio, desconocido, ambiguo, or null if resolved.
    """
    ids = {"uuid": F.col("id_persona"), "documento": F.col("documento"), "email": F.lower(F.trim("email")), "celular": phone_key(F.col("celular"))}
    entries = people.select("id_persona", F.explode(F.array(*(F.struct(F.lit(k).alias("__t"), v.alias("__v")) for k, v in ids.items()))).alias("x")).select("id_persona", "x.*")
    scoped = lambda alias: F.concat_ws("|", F.coalesce("origen", F.lit("")), alias)
    entries = entries.unionByName(aliases.filter("alias is not null").select("id_persona", F.lit("alias").alias("__t"), scoped(F.col("alias")).alias("__v")))
    owned = entries.filter("__v is not null and __v <> ''").groupBy("__t", "__v").agg(F.min("id_persona").alias("persona"), F.max("id_persona").alias("__u"))
    given = F.trim(value)
    key = F.when(F.col(kind) == "email", F.lower(given)).when(F.col(kind) == "celular", phone_key(given)).when(F.col(kind) == "alias", F.when(given != "", scoped(given))).otherwise(given)
    joined = values.withColumn("__t", F.col(kind)).withColumn("__v", F.nullif(key, F.lit(""))).join(owned, ["__t", "__v"], "left")
    known = F.coalesce(F.col("__t").isin(*ids, "alias"), F.lit(False))
    reason = F.when(~known, "tipo_desconocido").when(F.col("__v").isNull(), "vacio").when(F.col("persona").isNull(), "desconocido").when(F.col("persona") != F.col("__u"), "ambiguo")
    return joined.withColumn("motivo", reason).withColumn("persona", F.when(F.col("motivo").isNull(), F.col("persona"))).drop("__t", "__v", "__u")


def candidates(entries: DataFrame, people: DataFrame, keys: dict[str, Column], entry: str, person: str) -> DataFrame:
    """(entry, person, coincidencias, claves) of pairs that agree in any key: a union of equi-joins in place of a join by OR.

    The keys are applied to both sides. Pairs are of entries with people, so exact copies on one side don't pair among themselves.
    """
    found = None
    for name, key in keys.items():
        a = entries.select(F.col(entry).alias("a"), key.alias("k")).filter("k is not null and k <> ''")
        b = people.select(F.col(person).alias("b"), key.alias("k")).filter("k is not null and k <> ''")
        one = a.join(b, "k").select("a", "b", F.lit(name).alias("clave"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(F.col("a").alias(entry), F.col("b").alias(person)).agg(F.count_distinct("clave").alias("coincidencias"), F.array_join(F.array_sort(F.collect_set("clave")), ",").alias("claves"))


def key_statistics(rows: DataFrame, keys: dict[str, Column], suspicious_rows: int = 10, suspicious_share: float = 0.5) -> DataFrame:
    """Coverage, distinct values and colliding rows of identifiers, and whether one value takes so many rows as to be suspicious."""
    entries = F.array(*(F.struct(F.lit(n).alias("clave"), k.cast("string").alias("valor")) for n, k in keys.items()))
    counts = rows.select(F.explode(entries).alias("x")).groupBy("x.clave", "x.valor").agg(F.count(F.lit(1)).alias("k"))
    given = F.col("valor").isNotNull() & (F.col("valor") != "")
    out = counts.groupBy("clave").agg(
        F.sum("k").alias("filas"),
        F.sum(F.when(given, F.col("k")).otherwise(0)).alias("con_valor"),
        F.count_if(given).alias("distintos"),
        F.sum(F.when(given & (F.col("k") > 1), F.col("k")).otherwise(0)).alias("repetidas"),
        F.coalesce(F.max(F.when(given, F.col("k"))), F.lit(0)).alias("mayor"),
    )
    lost = F.col("con_valor") - F.col("distintos")
    return out.withColumn("sospechosa", (F.col("con_valor") >= suspicious_rows) & (lost >= suspicious_share * F.col("con_valor")))
