"""Topics of questions and of people."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortia.functions.expressions import fold


def attributed(answers: DataFrame, topic_questions: DataFrame, question: str, person: str) -> DataFrame:
    """(person, tema, apoyos): who answered a question that supports a topic, and how many such."""
    return answers.join(topic_questions, question).groupBy(person, "tema").agg(F.count_distinct(question).alias("apoyos"))


def counts_by_topic_and_area(facts: DataFrame, person: str) -> DataFrame:
    """Distinct people by (area, tema) and by area alone (tema null): people count once in an area whatever number of its topics they have."""
    return facts.groupingSets([["area", "tema"], ["area"]], "area", "tema").agg(F.count_distinct(person).alias("personas")).filter("personas > 0")


def topic_list(facts: DataFrame, person: str, separator: str = " | ") -> DataFrame:
    """Each person's topics in one text, sorted and distinct."""
    return facts.groupBy(person).agg(F.array_join(F.array_sort(F.collect_set("tema")), separator).alias("temas"))


def merged(facts: DataFrame, into: dict[str, str], person: str, keep: str) -> DataFrame:
    """Facts with topics re-pointed; of those that fall together the greatest `keep` stays."""
    target = F.col("tema")
    for old, new in into.items():
        target = F.when(F.col("tema") == old, F.lit(new)).otherwise(target)
    return facts.withColumn("tema", target).groupBy(person, "tema").agg(F.max(keep).alias(keep))


def unused(topics: DataFrame, facts: DataFrame) -> DataFrame:
    """Topics that nobody has."""
    return topics.join(facts.select("tema"), "tema", "left_anti")


def people_with(facts: DataFrame, catalogue: DataFrame, person: str, ids: list[str] = (), names: list[str] = (), areas: list[str] = (), special: bool = False) -> DataFrame:
    """(person) of those who have one of the topics named by id, by name (whatever the case and accents) or by whole area.

    catalogue: tema, area, especial; a topic is special by itself or by its area, which is if one of its topics is. Special topics count only if permitted.
    """
    marked = catalogue.withColumn("__e", F.max(F.coalesce("especial", F.lit(False))).over(Window.partitionBy("area")))
    asked = F.col("tema").isin(*ids) | fold(F.col("tema")).isin(*({_folded(n) for n in names})) | F.col("area").isin(*areas)
    wanted = marked.filter(asked & (F.lit(special) | ~F.col("__e"))).select("tema")
    return facts.join(wanted, "tema", "left_semi").select(person).distinct()


def _folded(name: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(ch)).strip()
