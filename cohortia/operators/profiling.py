"""Findings on the quality of texts and variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.functions.expressions import check_digit_valid, fold
from cohortia.operators.ingest import NO_ANSWER

# Patterns of personal data, in the order in which they take precedence.
PATTERNS = [
    ("correo", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("url", r"(?i)(?:https?://|www\.)\S+"),
    ("cedula", r"(?<![\d.])\d\.?\d{3}\.?\d{3}[-\s]?\d(?!\d)"),
    ("telefono", r"(?<![\d.])(?:\+?598[\s.-]?)?(?:0?9\d|[24]\d)[\s.-]?\d{3}[\s.-]?\d{3}(?!\d)"),
]
# Labels of the two options of questions with a mark, folded.
PAIRS = [
    ("checked", "unchecked"), ("yes", "no"), ("si", "no"), ("selected", "not selected"), ("seleccionado", "no seleccionado"),
    ("seleccionada", "no seleccionada"), ("marcado", "no marcado"), ("marcada", "no marcada"), ("mentioned", "not mentioned"),
    ("mencionado", "no mencionado"), ("mencionada", "no mencionada"), ("true", "false"), ("verdadero", "falso"),
]
# Names of fields that hold personal data.
PERSONAL_FIELDS = {
    "documento", "cedula", "ci", "dni", "pasaporte", "rut", "nombre", "nombres", "apellido", "apellidos", "nombre_completo", "email", "correo", "mail", "e_mail",
    "celular", "telefono", "movil", "whatsapp", "direccion", "domicilio", "fecha_nacimiento", "fecha_nac", "nacimiento", "fnac", "contacto", "observaciones",
}


def _named(hits: Column, kind: str) -> Column:
    return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("tipo"), v.alias("valor")))


def personal_data(texts: DataFrame, text: str) -> DataFrame:
    """texts with `hallazgos`, an array of (tipo, valor): personal data found, a kind at a time, what was found being blanked for the next."""
    rest, found = F.col(text), []
    for kind, pattern in PATTERNS:
        hits = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        if kind == "cedula":
            hits = F.filter(hits, check_digit_valid)
            found.append(_named(hits, kind))
            rest = F.aggregate(hits, rest, lambda t, v: F.replace(t, v, F.lit("·")))
        else:
            found.append(_named(hits, kind))
            rest = F.regexp_replace(rest, pattern, "·")
    return texts.withColumn("hallazgos", F.coalesce(F.concat(*found), F.array().cast("array<struct<tipo:string,valor:string>>")))


def personal_counts(texts: DataFrame, text: str, group: str) -> DataFrame:
    """(group, tipo, filas, hallazgos): texts with a hit of the kind, and hits."""
    hits = personal_data(texts.select(group, text, F.monotonically_increasing_id().alias("__r")), text)
    each = hits.select(group, "__r", F.explode("hallazgos").alias("x"))
    return each.groupBy(group, "x.tipo").agg(F.count_distinct("__r").alias("filas"), F.count(F.lit(1)).alias("hallazgos"))


def masked(texts: DataFrame, text: str) -> DataFrame:
    """texts with personal data replaced by the name of its kind."""
    out = F.col(text)
    for kind, pattern in PATTERNS:
        if kind == "cedula":
            hits = F.filter(F.regexp_extract_all(out, F.lit(pattern), F.lit(0)), check_digit_valid)
            out = F.aggregate(hits, out, lambda t, v: F.replace(t, v, F.lit("[cedula]")))
        else:
            out = F.regexp_replace(out, pattern, f"[{kind}]")
    return texts.withColumn(text, out)


def near_constant(distribution: DataFrame, share: float = 0.95, least: int = 20) -> DataFrame:
    """(codigo, valor, proporcion, respuestas) of variables of which one value takes the share or more of enough answers. distribution: codigo, valor, n."""
    total = F.sum("n").over(Window.partitionBy("codigo"))
    first = F.row_number().over(Window.partitionBy("codigo").orderBy(F.desc("n"), "valor"))
    placed = distribution.withColumn("respuestas", total).withColumn("__f", first).filter("__f = 1")
    return placed.filter((F.col("respuestas") >= least) & (F.col("n") >= share * F.col("respuestas"))).select("codigo", "valor", F.round(F.col("n") / F.col("respuestas"), 4).alias("proporcion"), "respuestas")


def no_answers(texts: DataFrame, text: str, group: str) -> DataFrame:
    """Texts of each group, and of these those that stand for no answer and those that are blank."""
    value = fold(F.col(text))
    return texts.groupBy(group).agg(F.count(F.lit(1)).alias("textos"), F.count_if(value.isin(NO_ANSWER)).alias("no_respuesta"), F.count_if(value.isNull() | (value == "")).alias("vacios"))


def preview(distribution: DataFrame, most: int = 3) -> DataFrame:
    """The most and least frequent values of each variable with their place: mas or menos, 1 first."""
    w = Window.partitionBy("codigo")
    high, low = F.row_number().over(w.orderBy(F.desc("n"), "valor")), F.row_number().over(w.orderBy("n", "valor"))
    placed = distribution.withColumn("__h", high).withColumn("__l", low)
    top = placed.filter(F.col("__h") <= most).select("codigo", F.lit("mas").alias("extremo"), F.col("__h").alias("lugar"), "valor", "n")
    return top.unionByName(placed.filter(F.col("__l") <= most).select("codigo", F.lit("menos").alias("extremo"), F.col("__l").alias("lugar"), "valor", "n"))


def inferred_types(distribution: DataFrame, most_options: int = 12) -> DataFrame:
    """(codigo, tipo) by shape of the values: numerica, fecha, cerrada (few values), abierta. distribution: codigo, valor, n."""
    number = F.expr("try_cast(valor as double)").isNotNull()
    day = F.expr("try_cast(valor as date)").isNotNull() & F.col("valor").rlike("^\\d{4}-\\d{2}-\\d{2}")
    out = distribution.groupBy("codigo").agg(F.count(F.lit(1)).alias("valores"), F.count_if(~number).alias("no_num"), F.count_if(~day).alias("no_fecha"), F.sum("n").alias("n"))
    kind = F.when(F.col("no_fecha") == 0, "fecha").when((F.col("no_num") == 0) & (F.col("valores") > most_options), "numerica").when(F.col("valores") <= most_options, "cerrada").otherwise("abierta")
    return out.select("codigo", kind.alias("tipo"), "valores")


def personal_columns(schema: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the fields of a schema, nested ones included, whose names are those of personal data."""
    out = []
    if isinstance(schema, T.StructType):
        for f in schema:
            path = f"{prefix}{f.name}"
            if f.name.lower() in PERSONAL_FIELDS:
                out.append(path)
            out += personal_columns(f.dataType, f"{path}.")
    elif isinstance(schema, T.ArrayType):
        out += personal_columns(schema.elementType, prefix)
    elif isinstance(schema, T.MapType):
        out += personal_columns(schema.valueType, prefix)
    return out


def batteries(questions: DataFrame, least: int = 3) -> DataFrame:
    """(raiz, preguntas, codigos) of multiple-answer batteries: questions whose codes differ in a numeric ending only."""
    root = F.regexp_replace("codigo", "[_.]?[0-9]+$", "")
    out = questions.withColumn("raiz", root).filter(F.col("raiz") != F.col("codigo")).groupBy("raiz").agg(F.count(F.lit(1)).alias("preguntas"), F.array_join(F.array_sort(F.collect_set("codigo")), ",").alias("codigos"))
    return out.filter(F.col("preguntas") >= least)


def cleaned_question(text: str):
    """Question text without instructions in brackets, numbering in front, and repeated or trailing marks."""
    out = F.regexp_replace(text, r"\s*[\(\[][^)\]]*(?:marque|seleccione|elija|respuesta)[^)\]]*[\)\]]", "")
    out = F.regexp_replace(out, r"^\s*(?:[A-Za-z]?\d+[.)\-:]\s*)+", "")
    out = F.regexp_replace(out, r"([?!.])\1+", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def marked_pairs(questions: DataFrame, distribution: DataFrame) -> DataFrame:
    """(codigo, marcado, no_marcado) of questions with two options of which one is a mark: by their labels, or 1 and 0 with labels
    that say nothing or none at all. questions: codigo, opciones (labels by code); distribution: codigo, valor."""
    seen = distribution.groupBy("codigo").agg(F.collect_set(F.when(F.col("valor").isin("0", "1"), F.col("valor"))).alias("unos"), F.count_if(~F.col("valor").isin("0", "1")).alias("otros"))
    entries = F.transform(F.map_entries("opciones"), lambda e: F.struct(e["key"].alias("codigo"), fold(e["value"]).alias("etiqueta")))
    out = questions.withColumn("e", entries).join(seen, "codigo", "left")
    first = lambda label: F.get(F.filter("e", lambda x: x["etiqueta"] == label), F.lit(0))["codigo"]
    two = F.size("e") == 2
    found = [F.when(two & first(yes).isNotNull() & first(no).isNotNull(), F.struct(first(yes).alias("marcado"), first(no).alias("no_marcado"))) for yes, no in PAIRS]
    codes = F.sort_array(F.transform("e", lambda x: x["codigo"])) == F.array(F.lit("0"), F.lit("1"))
    silent = two & codes & F.forall("e", lambda x: (x["etiqueta"] == "") | (x["etiqueta"] == x["codigo"]))
    bare = (F.size("e") == 0) & (F.size("unos") > 0) & (F.col("otros") == 0)
    plain = F.when(silent | bare, F.struct(F.lit("1").alias("marcado"), F.lit("0").alias("no_marcado")))
    return out.withColumn("x", F.coalesce(*found, plain)).filter("x is not null").select("codigo", "x.*")
