"""Whether texts affirm or reject, by word lists, and words in common with a criterion."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortia.functions.expressions import fold

# Words that negate, reject and affirm, and words without content; folded.
NEGATORS = ["no", "nunca", "jamas", "tampoco", "ni", "nada", "ningun", "ninguna", "ninguno"]
REJECTION = [
    "odio", "odia", "detesto", "detesta", "rechazo", "rechaza", "evito", "evita", "disgusta", "desagrada", "molesta", "aburre",
    "desconfio", "desconfia", "deje", "dejo", "abandone", "horrible", "malisimo", "pesimo", "espantoso",
]
ADHESION = [
    "si", "claro", "obvio", "siempre", "mucho", "muchisimo", "bastante", "me gusta", "gusta", "encanta", "adoro", "prefiero", "prefiere",
    "elijo", "elige", "uso", "usa", "consumo", "consume", "tomo", "toma", "compro", "compra", "recomiendo", "recomienda", "excelente",
    "buenisimo", "genial", "favorito", "fanatico", "seguido", "habitualmente", "todos los dias",
]
EMPTY = [
    "de", "del", "la", "las", "el", "los", "un", "una", "unos", "unas", "que", "quien", "quienes", "a", "al", "y", "o", "en", "con", "por",
    "para", "se", "su", "sus", "lo", "le", "les", "me", "mi", "gente", "personas", "persona", "es", "son", "esta", "estan", "ser", "hay",
]
VERIFIER_EMPTY = [*EMPTY, "no", "nunca", "jamas", "tampoco", "ni", "nada"]
ENOUGH = 0.34


def read(df: DataFrame, text: str, plain: str = "__plano", words: str = "__palabras") -> DataFrame:
    """df with the folded text and its distinct words, which the functions below take; computed once per row."""
    out = df.withColumn(plain, fold(F.col(text)))
    return out.withColumn(words, F.array_distinct(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))))


def words_of(text: str) -> list[str]:
    plain = "".join(ch for ch in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(ch))
    return list(dict.fromkeys(re.findall("[a-z0-9]+", plain)))


def sign(plain: Column, words: Column) -> Column:
    """-1 with any negator or rejection, else 1 with any adhesion, else 0."""
    rejects = F.arrays_overlap(words, F.array(*map(F.lit, NEGATORS + REJECTION)))
    affirms = F.arrays_overlap(words, F.array(*(F.lit(w) for w in ADHESION if " " not in w)))
    for phrase in (w for w in ADHESION if " " in w):
        affirms = affirms | plain.contains(phrase)
    return F.when(rejects, -1).when(affirms, 1).otherwise(0)


def sign_of(text: str) -> int:
    found = set(words_of(text))
    if found & set(NEGATORS + REJECTION):
        return -1
    plain = " ".join(words_of(text))
    return 1 if any(w in found or " " in w and w in plain for w in ADHESION) else 0


def opposite(criterion: str, found: Column) -> Column:
    """A text has a sign and it isn't the criterion's; a criterion without marks affirms."""
    return (found != 0) & (found != (sign_of(criterion) or 1))


def overlap(criterion: str, words: Column, empty: list[str]) -> Column:
    """Share of the criterion's content words among the words."""
    wanted = [w for w in words_of(criterion) if w not in empty and len(w) > 2]
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(words, F.array(*map(F.lit, wanted)))) / F.lit(len(wanted))


def score(criterion: str, found: Column, words: Column) -> Column:
    """Lexical relevance: overlap, less 2 for the opposite polarity. found: the text's sign."""
    return F.round(overlap(criterion, words, EMPTY) - F.when(opposite(criterion, found), 2.0).otherwise(0.0), 6)


def verdict(criterion: str, found: Column, words: Column) -> Column:
    """no_cumple for the opposite polarity, cumple for enough words, irrelevante for none, else dudoso."""
    common = overlap(criterion, words, VERIFIER_EMPTY)
    return F.when(opposite(criterion, found), "no_cumple").when(common >= ENOUGH, "cumple").when(common == 0, "irrelevante").otherwise("dudoso")
