"""Semantic queries: distinct evidence units, exact neighbours, gates, ranking, verdicts, and their combination by person.

Models work on distinct texts (units), never on answers; vectors stay out of what is joined after the top is chosen.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions import polarity
from cohortia.functions.providers import distance_to, least_distance, nearest_of
from cohortia.operators.participation import ranked
from cohortia.session import ship

PRIORITY = ["no_cumple", "cumple", "dudoso", "sin_verificar"]
FAR = 0.55
MOST_REFERENCES = 10_000
QUERIES = 1024  # of one pass over the vectors


@dataclass(frozen=True)
class SemanticCriterion:
    """A criterion in words; hard ones exclude in either mode."""

    text: str
    weight: float = 1.0
    hard: bool = False


@dataclass(frozen=True)
class QuerySpec:
    """A validated query: criteria with their order, mode, bounds."""

    criteria: tuple[SemanticCriterion, ...]
    mode: str = "estricto"
    top_n: int = 200
    top_k: int = 25
    limit: int = 50
    threshold: float = FAR
    seed: str | None = None
    demographic_weights: tuple[float, ...] = field(default=())

    def __post_init__(self):
        if not self.criteria and not self.demographic_weights:
            raise ValueError("a query needs a criterion")
        if self.mode not in ("estricto", "laxo"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not (0 < self.top_n <= 2000 and 0 < self.top_k <= 200 and self.limit > 0 and 0 <= self.threshold <= 2):
            raise ValueError("a bound is out of range")
        if any(c.weight <= 0 for c in self.criteria):
            raise ValueError("weights are positive")

    @classmethod
    def of(cls, raw: dict) -> QuerySpec:
        """From what a user sends; a criterion may be a text alone."""
        criteria = [c if isinstance(c, dict) else {"texto": c} for c in raw.get("criterios", [])]
        found = tuple(SemanticCriterion(str(c["texto"]).strip(), float(c.get("peso", 1)), bool(c.get("duro", False))) for c in criteria if str(c.get("texto", "")).strip())
        known = {k: raw[k] for k in ("top_n", "top_k", "threshold", "limit", "seed") if raw.get(k) is not None}
        return cls(found, raw.get("modo", "estricto"), demographic_weights=tuple(map(float, raw.get("pesos_demograficos", ()))), **known)


def units(answers: DataFrame, text: str, answer: str, person: str, question: str) -> DataFrame:
    """Distinct texts: hash, texto, respuestas, personas, preguntas, representante (lowest answer)."""
    given = answers.filter(F.trim(text) != "").withColumn("hash", F.sha2(text, 256))
    return given.groupBy("hash").agg(
        F.min(text).alias("texto"), F.count(F.lit(1)).alias("respuestas"), F.count_distinct(person).alias("personas"), F.count_distinct(question).alias("preguntas"), F.min(answer).alias("representante")
    )


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str, allowed: DataFrame | None = None) -> DataFrame:
    """The k nearest, exactly: (key, distancia, puesto), ties by key. `allowed` (key) is applied before the ranking."""
    if allowed is not None:
        vectors = vectors.join(allowed.select(key), key, "left_semi")
    near = vectors.select(key, distance_to(query, F.col(vector)).alias("distancia")).filter("distancia is not null")
    top = near.orderBy("distancia", key).limit(k)
    return top.withColumn("puesto", F.row_number().over(Window.orderBy("distancia", key)))


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, allowed: DataFrame | None = None) -> DataFrame:
    """The k nearest of each query (key, vector), exactly: (consulta, key, distancia, puesto), ties by key.

    The driver reads the queries in blocks of QUERIES; each block goes once over the vectors, which keeps the k best a query and task.
    """
    ship(vectors.sparkSession)
    if allowed is not None:
        vectors = vectors.join(allowed.select(key), key, "left_semi")
    kind = vectors.schema[key].dataType.simpleString()
    shape = f"consulta {kind}, {key} {kind}, distancia double"
    found = vectors.sparkSession.createDataFrame([], shape)
    rows = queries.select(key, vector).filter(F.col(vector).isNotNull()).toLocalIterator()
    while block := list(islice(rows, QUERIES)):
        near = nearest_of([r[0] for r in block], [r[1] for r in block], k)
        found = found.unionByName(vectors.select(key, vector).mapInPandas(near, shape))
    best = F.row_number().over(Window.partitionBy("consulta").orderBy("distancia", key))
    return found.withColumn("puesto", best).filter(F.col("puesto") <= k)


def recall_of(exact: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, puesto) of the exact neighbours that another search misses; of each query, where the searches have several."""
    keys = [*(c for c in ("consulta",) if c in exact.columns), key]
    return exact.join(other.select(*keys), keys, "left_anti").select(*keys, "puesto")


def rank_of(vectors: DataFrame, query: list[float], key: str, vector: str, wanted) -> DataFrame:
    """(key, delante): how many are strictly nearer than one of them."""
    near = vectors.select(key, F.round(distance_to(query, F.col(vector)), 9).alias("d"))
    own = near.filter(F.col(key) == wanted).select("d").scalar()
    return near.filter(F.col("d") < own).agg(F.count(F.lit(1)).alias("delante")).select(F.lit(wanted).alias(key), "delante")


def near_any(candidates: DataFrame, references: DataFrame, key: str, vector: str, most: float = 0.45, limit: int = 20) -> DataFrame:
    """(key, distancia) of candidates by the least distance to any reference.

    References are few (the questions of one series) and sent to the tasks; more than MOST_REFERENCES are an error.
    """
    wanted = [r[0] for r in references.select(vector).limit(MOST_REFERENCES + 1).collect()]
    if len(wanted) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    near = candidates.withColumn("distancia", F.round(least_distance(wanted, F.col(vector)), 6))
    return near.filter(F.col("distancia") <= most).orderBy("distancia", key).limit(limit).select(key, "distancia")


def reranked(pool: DataFrame, score: str = "relevancia") -> DataFrame:
    """pool with `clave_orden`: the relevance within [0, 1] if every unit has one, else the order by distance for all."""
    whole = pool.agg(F.count(score) == F.count(F.lit(1))).scalar()
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return pool.withColumn("clave_orden", F.when(whole, -clamped).otherwise(F.col("distancia")))


def best_evidence(pool: DataFrame, person: str, order: list[Column], most: int = 3) -> DataFrame:
    """The first pieces of evidence of each person with their place."""
    return pool.withColumn("lugar", F.row_number().over(Window.partitionBy(person).orderBy(*order))).filter(F.col("lugar") <= most)


def judged(answers: DataFrame, criteria: list[SemanticCriterion], text: str) -> DataFrame:
    """answers once per criterion with criterio (place), veredicto and relevancia by the lexical providers; each distinct text is judged once."""
    found = answers.filter(F.trim(text) != "").withColumn("hash", F.sha2(text, 256))
    distinct = polarity.read(found.groupBy("hash").agg(F.min(text).alias("__t")), "__t")
    plain, words, sign = F.col("__plano"), F.col("__palabras"), F.col("__signo")
    signed = distinct.withColumn("__signo", polarity.sign(plain, words))
    entries = [
        F.struct(
            F.lit(k).alias("criterio"), polarity.verdict(c.text, sign, words).alias("veredicto"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), polarity.score(c.text, sign, words))).alias("relevancia")
        )
        for k, c in enumerate(criteria)
    ]
    return found.join(signed.select("hash", F.explode(F.array(*entries)).alias("x")).select("hash", "x.*"), "hash")


def findings(verdicts: DataFrame, person: str, answer: str) -> DataFrame:
    """(person, criterio, veredicto, puntaje, evidencia, contradiccion): each person's representative evidence by priority of the verdict, then relevance, then answer."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("veredicto")), F.lit(0))
    rank = F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank)
    first = F.min_by(F.struct("veredicto", "relevancia", answer), F.struct(rank, -F.col("relevancia"), F.col(answer)))
    kinds = F.collect_set("veredicto")
    out = verdicts.groupBy(person, "criterio").agg(first.alias("x"), kinds.alias("k"), F.count_if(F.col("veredicto") == "sin_verificar").alias("pendientes"))
    both = F.array_contains("k", "cumple") & F.array_contains("k", "no_cumple")
    return out.select(person, "criterio", "x.veredicto", F.col("x.relevancia").alias("puntaje"), F.col(f"x.{answer}").alias("evidencia"), "pendientes", both.alias("contradiccion"))


def combined(found: DataFrame, spec: QuerySpec, person: str) -> DataFrame:
    """(person, puntaje, estado, confianza, exclusion): all people with a finding under all criteria.

    The first criterion that excludes gives the reason. A person without a finding for a criterion scores 0 on it.
    """
    order = F.array(*(F.struct(F.lit(k).alias("criterio"), F.lit(float(c.weight)).alias("peso"), F.lit(c.hard or spec.mode == "estricto").alias("excluye")) for k, c in enumerate(spec.criteria)))
    each = found.select(person).distinct().select(person, F.explode(order).alias("c")).select(person, "c.*")
    full = each.join(found, [person, "criterio"], "left")
    v = F.coalesce("veredicto", F.lit("sin_evidencia"))
    score = F.when(v.isin("sin_evidencia", "irrelevante", "no_cumple"), 0.0).otherwise(F.col("puntaje"))
    reason = F.when(v == "no_cumple", v).when(F.col("excluye") & v.isin("sin_evidencia", "irrelevante", "dudoso"), v)
    extra = float(sum(spec.demographic_weights))
    out = full.groupBy(person).agg(
        ((F.sum(score * F.col("peso")) + extra) / (F.sum("peso") + extra)).alias("s"),
        F.min_by(F.when(reason.isNotNull(), reason), F.when(reason.isNotNull(), F.col("criterio"))).alias("r"),
        F.bool_or(v.isin("sin_evidencia", "dudoso", "irrelevante")).alias("penalizado"),
        F.bool_or(v == "sin_verificar").alias("incompleta"),
        F.bool_or(v.isin("cumple", "no_cumple", "dudoso", "sin_verificar")).alias("pertinente"),
        F.max("puntaje").alias("mejor"),
    )
    excluded = F.coalesce("r", F.when(~F.col("pertinente"), "sin_evidencia_pertinente"))
    low = F.col("penalizado") | F.col("incompleta") | (1 - F.coalesce("mejor", F.lit(0.0)) > spec.threshold)
    state = F.when(F.col("incompleta"), "pendiente").when(F.col("penalizado"), "posible").otherwise("confirmada")
    return out.select(person, F.round("s", 4).alias("puntaje"), state.alias("estado"), F.when(low, "baja").otherwise("alta").alias("confianza"), excluded.alias("exclusion"))


def drawn_matching(pools: DataFrame, criteria: int, person: str, seed: str, limit: int, most_verified: int = 4) -> DataFrame:
    """(person, lugar): a seeded draw of people that are in every criterion's pool and confirmed under all, among the first most_verified * limit of the draw.

    pools: person, criterio, veredicto of the best evidence within the distance.
    """
    inside = pools.groupBy(person).agg(F.count_distinct("criterio").alias("n"), F.bool_and(F.col("veredicto") == "cumple").alias("ok")).filter(F.col("n") == criteria)
    order = [F.md5(F.concat(F.col(person).cast("string"), F.lit(seed))), F.col(person)]
    first = inside.orderBy(*order).limit(most_verified * limit)
    return first.filter("ok").withColumn("lugar", F.row_number().over(Window.orderBy(*order))).filter(F.col("lugar") <= limit).select(person, "lugar")


def estimated_cost(units: DataFrame, batch: int = 25, margin: float = 1.25, tokens_per_char: float = 0.25, price: float = 3.0) -> DataFrame:
    """(unidades, llamadas, tokens, costo) of verifying all units: batches, characters by tokens, price per million, with a margin."""
    n = F.count(F.lit(1))
    tokens = F.ceil(F.sum(F.length("texto")) * tokens_per_char)
    return units.agg(n.alias("unidades"), F.ceil(n / batch).alias("llamadas"), tokens.alias("tokens"), F.round(tokens / 1e6 * price * margin, 6).alias("costo"))


def inconsistent_units(answers: DataFrame, stored: DataFrame) -> DataFrame:
    """(problema, n): texts whose hash has no unit, and units that no answer has."""
    hashes = answers.filter(F.trim("text") != "").select(F.sha2("text", 256).alias("hash")).distinct().withColumn("a", F.lit(1))
    both = hashes.join(stored.select("hash", F.lit(1).alias("u")), "hash", "full")
    kind = F.when(F.col("u").isNull(), "sin_unidad").when(F.col("a").isNull(), "huerfana")
    return both.withColumn("problema", kind).filter("problema is not null").groupBy("problema").agg(F.count(F.lit(1)).alias("n"))


def ranking(found: DataFrame, person: str, limit: int) -> DataFrame:
    """The people that no criterion excludes with their place: by score, then person."""
    top = found.filter("exclusion is null").orderBy(F.desc("puntaje"), person).limit(limit)
    return top.withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("puntaje"), person)))


def units_summary(found: DataFrame) -> DataFrame:
    """(unidades, mayor, mediana, de_una): people per unit; the median is exact."""
    return found.agg(F.count(F.lit(1)).alias("unidades"), F.max("personas").alias("mayor"), F.median("personas").alias("mediana"), F.count_if(F.col("personas") == 1).alias("de_una"))


def eligible(answers: DataFrame, allowed: DataFrame, person: str, answer: str, text: str, vectors: DataFrame, query: list[float], most: float | None = None) -> DataFrame:
    """(hash, answer, distancia) of the units that a permitted person has given, by their lowest answer, within the distance if one is given.

    The gate is one semi-join before the units are formed; vectors (answer, embedding) are read for the distance only. Units without a vector are left out.
    """
    own = answers.filter(F.trim(text) != "").join(allowed.select(person), person, "left_semi")
    formed = own.groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(answer).alias(answer))
    near = vectors.select(answer, distance_to(query, F.col("embedding")).alias("distancia")).filter("distancia is not null")
    near = near if most is None else near.filter(F.col("distancia") <= most)
    return formed.join(near, answer).select("hash", answer, "distancia")


def frozen_batches(found: DataFrame, size: int) -> DataFrame:
    """found (hash, ...) with `lote` from 0: batches of `size` units in the order of their hash, the same at every run."""
    placed, _ = ranked(found, [F.col("hash")])
    return placed.withColumn("lote", F.floor((F.col("puesto") - 1) / size)).drop("puesto")


def process_batches(frozen: DataFrame, criterion: SemanticCriterion, first: int, last: int) -> DataFrame:
    """(hash, veredicto, relevancia) of the batches from `first` up to, not including, `last`: what a budget allows in one go."""
    chosen = frozen.filter(F.col("lote").between(first, last - 1)).select("texto")
    return judged(chosen, [criterion], "texto").select("hash", "veredicto", "relevancia")


def verdict_upsert(known: DataFrame | None, new: DataFrame) -> DataFrame:
    """The table of verdicts with the new ones, which replace those of the same units; repeating a batch changes nothing."""
    new = new.dropDuplicates(["hash"])
    return new if known is None else known.join(new.select("hash"), "hash", "left_anti").unionByName(new)


def assembled(frozen: DataFrame, known: DataFrame) -> DataFrame:
    """All units with the verdicts there are; those of batches not yet processed are sin_verificar."""
    return frozen.join(known, "hash", "left").withColumn("veredicto", F.coalesce("veredicto", F.lit("sin_verificar")))
