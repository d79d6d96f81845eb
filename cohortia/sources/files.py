"""Files in and out: wide CSV, CSV of results, upserts of Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.session import ship
from cohortia.sources.spreadsheets import WideSpreadsheet
from cohortia.sources.spss import SavWide

# Fields that may leave with names, in this order.
IDENTIFIED_FIELDS = ["id_persona", "nombre", "documento", "email", "celular", "localidad"]


def register(spark: SparkSession) -> None:
    """Makes the formats xlsx_wide and sav_wide known to the session."""
    ship(spark)
    spark.dataSource.register(WideSpreadsheet)
    spark.dataSource.register(SavWide)


def wide_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A wide CSV as text columns: columns without a name and rows without any value are left out."""
    df = spark.read.csv(path, header=True, sep=separator, inferSchema=False, multiLine=True, escape='"')
    named = [c for c in df.columns if c.strip() and not (c.startswith("_c") and c[2:].isdigit())]
    out = df.select(*(F.col(f"`{c}`").alias(c.strip()) for c in named))
    filled = F.lit(False)
    for c in out.columns:
        filled = filled | F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False))
    return out.filter(filled)


def ranking_lines(ranking: DataFrame, evidence: DataFrame, person: str, order: Column) -> DataFrame:
    """(person, puntaje, evidencia): each person's evidence as `[study · code] text`, joined by ` | ` in the given order.

    evidence: person, estudio, codigo, texto; a person has a few pieces of evidence, chosen before.
    """
    piece = F.concat(F.lit("["), F.col("estudio"), F.lit(" · "), F.col("codigo"), F.lit("] "), F.col("texto"))
    listed = evidence.groupBy(person).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), piece.alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["t"]), " | ")
    return ranking.join(listed, person, "left").select(person, "puntaje", text.alias("evidencia"))


def identified(people: DataFrame, ranking: DataFrame, person: str = "id_persona") -> DataFrame:
    """The ranking with the fields that may leave with names, and no others."""
    fields = [c for c in IDENTIFIED_FIELDS if c in people.columns]
    return ranking.join(people.select(*fields), person, "left").select(*fields, *(c for c in ranking.columns if c not in fields))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def from_arrays(spark: SparkSession, arrays: dict[str, list], schema: str) -> DataFrame:
    """Rows from arrays of equal length, one per column."""
    if len({len(a) for a in arrays.values()}) > 1:
        raise ValueError("the arrays differ in length")
    return spark.createDataFrame(list(zip(*arrays.values())), schema)


def sample_for_field(facts: DataFrame, people: DataFrame, with_contact: bool = False, person: str = "id_persona") -> DataFrame:
    """A survey's sample for the field: the facts with codes of people, with contact data on demand only."""
    fields = ["nombre", "celular", "email"] if with_contact else []
    return facts.join(people.select(person, *fields), person) if fields else facts


def options_to_columns(answers: DataFrame, key: str, code: str, value: str, options: dict[str, list[str]], multiple: set[str]) -> DataFrame:
    """Wide rows of codes: closed questions as 1..n by the order of their options, questions with several answers as a column of 0 and 1 per option.

    answers: key, code, value (one row per chosen option).
    """
    columns = []
    for question, choices in options.items():
        asked = F.col(code) == question
        if question in multiple:
            columns += [F.max(F.when(asked, (F.col(value) == c).cast("int"))).alias(f"{question}_{n}") for n, c in enumerate(choices, 1)]
        else:
            place = F.array_position(F.array(*map(F.lit, choices)), F.col(value))
            columns.append(F.max(F.when(asked & (place > 0), place.cast("int"))).alias(question))
    return answers.groupBy(key).agg(*columns)
