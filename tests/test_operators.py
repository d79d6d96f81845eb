"""Small scenarios with known results."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.functions import polarity
from cohortia.functions.criteria import Criterion, from_catalogue, normalise
from cohortia.functions.expressions import check_digit_valid, completed_years, cosine_distance, fold, phone_key
from cohortia.functions.providers import BagOfWords, TransientError, Verifier, embedded, verified
from cohortia.operators import ann, composition, diagnosis, identity, ingest, ledger, participation, profiling, quality, sampling, segments, semantic, skew, topics


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "bad",
    [{"dimension": "x", "valor": 1}, {"dimension": "sexo", "operador": "cerca", "valor": "F"}, {"dimension": "sexo", "operador": "in", "valor": []}, {"dimension": "sexo", "operador": "gt", "valor": "F"}, {"dimension": "edad", "operador": "gt", "valor": "x"}, {"dimension": "sexo", "valor": None}, {"dimension": "sexo", "valor": ["F"]}],
)
def test_malformed_criteria_are_errors(bad):
    with pytest.raises(ValueError):
        normalise(bad, ["sexo", "edad"], ["edad"])


def test_catalogue_filters():
    assert from_catalogue({"edad": {"min": 3.0}}, {"edad": "derivado"}) == [Criterion("edad", "gte", (3.0,))]
    for bad in ({"x": {"en": ["a"]}}, {"sexo": {"min": 1}}, {"sexo": {"en": ["z"]}}):
        with pytest.raises(ValueError):
            from_catalogue(bad, {"sexo": "categorico"}, {"sexo": ["a"]})


def test_missing_values_meet_no_criterion(spark):
    wide = spark.createDataFrame([("a", "F", 30), ("b", None, 40), ("c", "M", None)], "id_persona string, sexo string, edad int")
    values = segments.stacked(wide, "id_persona", ["sexo"], ["edad"])
    people = wide.select("id_persona")
    assert rows(segments.matching(people, values, [Criterion("sexo", "ne", ("M",))])) == [("a",)]
    assert rows(segments.matching(people, values, [Criterion("edad", "not_in", (30.0,))])) == [("b",)]


def test_draw_is_stable_and_pages_cover_the_segment(spark):
    people = spark.range(1000).select(F.col("id").cast("string").alias("p"))
    first = rows(segments.drawn(people, "p", "s", 300))
    assert first == rows(segments.drawn(people.repartition(7), "p", "s", 300))
    pages = [rows(segments.drawn(people, "p", "s", 400, k)) for k in (0, 400, 800)]
    assert sorted(r[0] for page in pages for r in page) == sorted(str(k) for k in range(1000))


def test_ages_and_phones(spark):
    df = spark.createDataFrame([("2000-02-29", "2023-02-28"), ("2000-02-29", "2023-03-01"), ("1990-05-10", "2020-05-10")], "b string, t string").select(completed_years(F.to_date("b"), F.to_date("t")))
    assert [r[0] for r in df.collect()] == [22, 23, 30]
    phones = ["099 123 456", "+598 99123456", "0059899123456", "59899123456", "12", None, "", "abc"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in phones], "p string").select(phone_key(F.col("p"))).collect()]
    assert got == ["+59899123456"] * 4 + [None] * 4


def test_composition(spark):
    people = spark.createDataFrame([(1, "F"), (1, "F"), (1, "M"), (1, None)], "panel int, sexo string")
    goal = spark.createDataFrame([(1, "sexo", "F", 0.5), (1, "sexo", "X", 0.5)], "panel int, dimension string, categoria string, proporcion double")
    out = {r["categoria"]: r for r in composition.against_targets(composition.observed(people, ["panel"], ["sexo"]), goal, ["panel"]).collect()}
    assert (out["F"]["actual"], out["F"]["brecha"], out["F"]["esperados"], out["F"]["faltan"]) == (0.6667, 0.1667, 2, 0)
    assert (out["X"]["n"], out["X"]["faltan"], out["M"]["esperados"]) == (0, 2, None)
    assert rows(composition.dissimilarity(composition.against_targets(composition.observed(people, ["panel"], ["sexo"]), goal, ["panel"]), ["panel"])) == [(1, "sexo", 0.3334)]


def test_upper_median_and_concentration(spark):
    values = spark.createDataFrame([("a", v) for v in (1, 1, 5, 9)] + [("b", 3), ("b", None)], "g string, v int")
    assert rows(participation.upper_median(values, "v", ["g"])) == [("a", 5), ("b", 3)]
    profile = spark.createDataFrame([(k, k % 7) for k in range(25)], "persona int, convocatorias long")
    got = participation.concentration(profile).first()
    calls = sorted((k % 7 for k in range(25)), reverse=True)
    assert (got["cabeza"], got["llamados"], got["total"]) == (2, sum(calls[:2]), sum(calls))


def test_places_in_a_total_order(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "v int")
    placed, n = participation.ranked(df, [F.col("v")], 5)
    assert rows(placed) == [(v, v + 1) for v in range(101)] and n.first()[0] == 101


def greedy(people, targets, size, cap=3):
    taken = {c: 0 for c in targets}
    mean, left, out = sum(p[3] for p in people) / len(people), list(people), []
    while left and len(out) < size:
        def score(p):
            deficit = targets[p[1]] - taken[p[1]]
            cost = round(1.0 * min(1.0, p[2] / cap) + 0.5 * p[3] / (1 + mean), 12)
            return (round(10.0 * (2 * deficit - 1) / size - cost, 12), -p[2], -p[3], p[4], p[0])
        open_ = [p for p in left if targets.get(p[1], 0) - taken.get(p[1], 0) > 0]
        if not open_:
            break
        best = max(open_, key=score)
        out.append(best[0])
        taken[best[1]] += 1
        left.remove(best)
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_optimiser_equals_the_step_by_step_greedy(spark, seed):
    rnd = random.Random(seed)
    people = [(k, rnd.choice("ABC"), rnd.randint(0, 4), rnd.randint(0, 6), rnd.randint(0, 4)) for k in range(60)]
    targets = {"A": rnd.randint(0, 9), "B": rnd.randint(0, 9), "C": rnd.randint(0, 9)}
    df = spark.createDataFrame(people, "persona long, categoria string, recientes long, totales long, respondidas long")
    goal = spark.createDataFrame(list(targets.items()), "categoria string, meta long")
    found = sampling.optimised(df, goal, 15, "persona")
    assert sorted(r["persona"] for r in found.collect()) == greedy(people, targets, 15)


@pytest.mark.parametrize("seed", range(4))
def test_expiry_equals_one_lot_after_the_other(spark, seed):
    rnd = random.Random(seed)
    lots = [(rnd.choice("ab"), float(rnd.randint(1, 50)), rnd.randint(1, 9), k) for k in range(30)]
    balance = {"a": float(rnd.randint(0, 400)), "b": 0.0}
    want, left = [], dict(balance)
    for who, amount, due, key in sorted(lots, key=lambda x: (x[0], x[2], x[3])):
        taken = min(amount, left[who])
        left[who] -= taken
        want.append((who, key, taken))
    found = ledger.expired(spark.createDataFrame(lots, "q string, monto double, vence int, k int"), spark.createDataFrame(list(balance.items()), "q string, saldo double"), "q", "monto", "vence", "k")
    assert rows(found) == sorted(want)


def test_straight_lines_and_copies(spark):
    answers = spark.createDataFrame([("a", "3"), ("a", "3"), ("a", "3"), ("a", "3"), ("b", "1"), ("b", "5"), ("b", "1"), ("b", "5"), ("c", "x"), ("c", "x"), ("c", "x"), ("c", "x"), ("d", "1")], "p string, valor string")
    assert [(r["p"], r["plano"]) for r in quality.straight_lines(answers, ["p"]).orderBy("p").collect()] == [("a", True), ("b", False), ("c", True)]
    same = quality.same_content(answers.unionByName(spark.createDataFrame([("e", "1")], "p string, valor string")), "p", "valor").first()
    assert (same["personas"], same["primera"]) == (2, "d")


def test_dedup_cascade(spark):
    people = spark.createDataFrame([("p1", "Ana Paz", "D1", "ana@x.y", "099111222", None), ("p2", "Luis Rey", "D2", None, "099333444", None), ("p3", "Mar Sol", None, None, None, datetime(1990, 1, 1).date())], "id_persona string, nombre string, documento string, email string, celular string, fecha_nacimiento date")
    new = [(1, "Otra", "D1", None, None, None), (2, "X", None, "ANA@X.Y", None, None), (3, "Luis Rey Paz", None, None, "+59899333444", None), (4, "Eva", None, None, "099333444", None), (5, "mar sol", None, None, None, datetime(1990, 1, 1).date()), (6, "Nadie", "D9", None, "099333444", None), (7, None, None, None, None, None)]
    got = {r["id"]: (r["decision"], r["persona"], r["regla"]) for r in identity.decide(spark.createDataFrame(new, "id int, nombre string, documento string, email string, celular string, fecha_nacimiento date"), people).collect()}
    assert got == {1: ("reutiliza", "p1", "documento"), 2: ("reutiliza", "p1", "email"), 3: ("reutiliza", "p2", "celular"), 4: ("revision", None, "celular_dudoso"), 5: ("revision", "p3", "nombre_fecha"), 6: ("crea", None, "ninguna"), 7: ("crea", None, "ninguna")}


CORPUS = [("ana", 1, "me encanta el fernet con cola"), ("beto", 2, "odio el fernet"), ("cora", 3, "el transporte llega tarde"), ("dani", 4, None), ("elena", 5, "tomo fernet siempre"), ("ana", 6, "  ")]


def test_semantic_query_over_five_people(spark):
    answers = spark.createDataFrame(CORPUS, "persona string, id int, texto string")
    allowed = answers.filter("persona <> 'elena'")  # the gate comes before the pool
    spec = semantic.QuerySpec.of({"criterios": ["gente a la que le gusta el fernet"]})
    found = semantic.findings(semantic.judged(allowed, list(spec.criteria), "texto"), "persona", "id")
    out = {r["persona"]: (r["estado"], r["exclusion"]) for r in semantic.combined(found, spec, "persona").collect()}
    assert out == {"ana": ("confirmada", None), "beto": ("confirmada", "no_cumple"), "cora": ("posible", "irrelevante")}
    lax = semantic.combined(found, semantic.QuerySpec.of({"criterios": ["gente a la que le gusta el fernet"], "modo": "laxo"}), "persona")
    assert {r["persona"]: r["exclusion"] for r in lax.collect()}["cora"] == "sin_evidencia_pertinente"


def test_polarity(spark):
    texts = [("no me gusta", -1), ("me gusta", 1), ("nadaba en el rio", 0), ("TODOS LOS DÍAS", 1), ("", 0)]
    got = polarity.read(spark.createDataFrame(texts, "t string, s int"), "t").select(polarity.sign(F.col("__plano"), F.col("__palabras")), "s").collect()
    assert all(a == b for a, b in got)
    assert [polarity.sign_of(t) for t, _ in texts] == [s for _, s in texts]


@pytest.mark.parametrize("bad", [{}, {"criterios": ["a"], "modo": "x"}, {"criterios": ["a"], "top_n": 5000}, {"criterios": [{"texto": "a", "peso": 0}]}])
def test_malformed_queries_are_errors(bad):
    with pytest.raises(ValueError):
        semantic.QuerySpec.of(bad)


def test_neighbours_and_embedding(spark):
    units = embedded(spark.createDataFrame([(k, t) for k, t in enumerate(["fernet con cola", "fernet solo", "tren tarde", None])], "k int, texto string"), BagOfWords(32))
    query = BagOfWords(32).embed(["fernet con cola"])[0].tolist()
    near = semantic.nearest(units, query, 2, "k", "vector").collect()
    assert [(r["k"], r["puesto"]) for r in near] == [(0, 1), (1, 2)] and near[0]["distancia"] < 1e-6
    plain = units.select(cosine_distance(F.col("vector"), F.array(*map(F.lit, query)))).first()[0]
    assert abs(plain - near[0]["distancia"]) < 1e-6
    assert semantic.nearest(units.withColumn("vector", F.lit(None).cast("array<float>")), query, 2, "k", "vector").count() == 0


def test_a_failing_batch_is_halved(spark):
    class Fussy(Verifier):
        def verdicts(self, criterion, texts):
            if "malo" in texts:
                raise TransientError("one text spoils the batch")
            return ["cumple" if "si" in t else "raro" for t in texts]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["si", "malo", "no", "si"])], "k int, texto string").coalesce(1)
    assert [r["veredicto"] for r in verified(df, Fussy(), "c", batch=25).orderBy("k").collect()] == ["cumple", "sin_verificar", "sin_verificar", "cumple"]


def test_a_broken_verifier_is_an_error(spark):
    class Broken(Verifier):
        def verdicts(self, criterion, texts):
            raise KeyError("a mistake")

    df = spark.createDataFrame([(1, "si")], "k int, texto string")
    with pytest.raises(Exception, match="a mistake"):
        verified(df, Broken(), "c").collect()
    assert verified(df, Broken(), "c", seconds=0).first()["veredicto"] == "sin_verificar"


def test_folding_of_marks_and_rare_letters(spark):
    texts = spark.createDataFrame([("jama\u0301s",), ("JAMÁS",), (" Ő Ệ ",), (None,)], "t string")
    assert [r[0] for r in texts.select(fold(F.col("t"))).collect()] == ["jamas", "jamas", "o e", None]


def test_rule_sample_is_trimmed_and_completed(spark):
    people = [(f"p{k:02}", "a" if k < 3 else "b" if k < 20 else "c", k, 0, 0) for k in range(30)]
    eligible = spark.createDataFrame(people, "persona string, categoria string, recientes int, totales int, respondidas int")
    quota = spark.createDataFrame([("a", 5, 6), ("b", 4, 4)], "categoria string, faltan long, cupo long")
    got = rows(sampling.by_quota(eligible, quota, "persona", 10).select("categoria", "completa", "persona"))
    assert [x[0] for x in got].count("a") == 3 and [x[0] for x in got].count("b") == 7 and sum(x[1] for x in got) == 3
    assert rows(sampling.by_quota(eligible, quota, "persona", 2).select("persona")) == [("p00",), ("p01",)]
    assert sampling.by_quota(eligible.limit(0), quota, "persona", 5).count() == 0
    assert rows(sampling.shortfalls(eligible, quota)) == [("a", 5, 6, 3)]


def test_approximate_search(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(8, 16)) * 4
    vectors = [(k, (centres[k % 8] + rnd.normal(size=16)).tolist(), "x") for k in range(900)] + [(900, None, "x"), (901, [], "x"), (902, [1.0], "x")]
    df = spark.createDataFrame(vectors, "k long, v array<double>, lista string").repartition(3)
    queries = df.filter("k % 20 = 0")
    exact = semantic.nearest_each(df.select("k", "v"), queries, 10, "k", "v")
    index = ann.fitted(df, "k", "v", lists=16, probes=4, sample=300)
    got = ann.search(index, df, queries, 10, "k", "v")
    told = ann.audit(exact.filter("consulta < 900"), got, "k").collect()
    assert len(told) == 45 and sum(r["exactitud"] for r in told) / 45 >= 0.95
    assert all(r["primer_lugar"] is None or r["faltan"] for r in told)
    whole = ann.fitted(df, "k", "v", lists=16, probes=16, sample=300)
    assert ann.audit(exact.filter("consulta < 900"), ann.search(whole, df, queries, 10, "k", "v"), "k").filter("faltan > 0").count() == 0
    assert ann.search(ann.fitted(df.limit(0), "k", "v"), df.limit(0), queries.limit(0), 3, "k", "v").count() == 0


def test_diagnosis_of_a_file(spark):
    cells = [("vacia", None)] * 30 + [("fija", "x")] * 29 + [("fija", "X")] + [("nombre", "ana@x.com "), ("nombre", "Ns/Nc"), ("nombre", "JosÃ©")] + [("nombre", "")] * 27
    out = {(r["codigo"], r["tipo"]): (r["severidad"], r["cuantos"]) for r in diagnosis.diagnosed(spark.createDataFrame(cells, "codigo string, valor string"), 30).collect()}
    assert out == {
        ("vacia", "variable_vacia"): (2, 30), ("fija", "casi_constante"): (3, 29), ("fija", "formas_de_un_valor"): (3, 1), ("nombre", "datos_personales"): (1, 1),
        ("nombre", "espacios"): (3, 1), ("nombre", "no_respuesta"): (2, 1), ("nombre", "codificacion"): (1, 1), ("nombre", "mayormente_vacia"): (3, 27),
    }
    assert diagnosis.diagnosed(spark.createDataFrame([], "codigo string, valor string"), 0).count() == 0


def test_ingestion_of_a_file(spark):
    wide = spark.createDataFrame([(1, "D1", "sí", None, True), (2, "D2", " ", "no sabe", True), (3, "D1", "sí", "b", None), (4, None, "x", "y", True), (5, "D3", "z", "z", True)], "id int, doc string, p string, q string, ok boolean")
    people = spark.createDataFrame([("D1", "A"), ("D2", "B"), ("D3", "C"), ("D3", "D"), ("D1", "A"), (None, "E")], "doc string, id_persona string")
    out = {r["destino"]: (r["celdas"], r["filas"], r["personas"], r["unidades"]) for r in ingest.summary(ingest.ingested(wide, "id", ["p", "q"], "doc", people, F.col("ok")), "id").collect()}
    assert out == {"cargada": (1, 1, 1, 1), "vacia": (2, 2, 2, 0), "no_respuesta": (1, 1, 1, 0), "sin_permiso": (2, 1, 1, 0), "sin_persona": (4, 2, 0, 0)}


def test_frozen_batches_and_verdicts(spark):
    units = spark.createDataFrame([(f"{k:03}", "me gusta el precio" if k % 2 else "otra cosa") for k in range(25)], "hash string, texto string")
    frozen = semantic.frozen_batches(units, 10)
    assert rows(frozen.groupBy("lote").count()) == [(0, 10), (1, 10), (2, 5)]
    new = spark.createDataFrame([("000", "cumple", 1.0)], "hash string, veredicto string, relevancia double")
    known = semantic.verdict_upsert(semantic.verdict_upsert(None, new), new.withColumn("veredicto", F.lit("dudoso")))
    out = {r["hash"]: r["veredicto"] for r in semantic.assembled(frozen, known).collect()}
    assert len(out) == 25 and out["000"] == "dudoso" and out["001"] == "sin_verificar"


def test_personal_data_is_masked(spark):
    texts = spark.createDataFrame([("CI 1.234.567-2, mail a@b.com, www.x.com",), (None,), ("",), ("nada",)], "t string")
    assert [r[0] for r in profiling.masked(texts, "t").collect()] == ["CI [cedula], mail [correo], [url]", None, "", "nada"]


def test_personal_data(spark):
    texts = [("escribí a ana.p@mail.com o www.x.com/y",), ("mi cédula 1.234.567-2 y cel 099 123 456",), ("ref 12345678",), (None,), ("",)]
    found = profiling.personal_data(spark.createDataFrame(texts, "t string"), "t").select("hallazgos").collect()
    assert [[h["tipo"] for h in r[0]] for r in found] == [["correo", "url"], ["cedula", "telefono"], [], [], []]
    assert spark.createDataFrame([("12345672",), ("12345678",)], "n string").select(check_digit_valid(F.col("n"))).collect() == [(True,), (False,)]


def test_personal_columns_in_nested_schemas(spark):
    schema = spark.createDataFrame([], "id int, persona struct<nombre:string, x:array<struct<email:string>>>, m map<string, struct<celular:string>>").schema
    assert profiling.personal_columns(schema) == ["persona.nombre", "persona.x.email", "m.celular"]


def test_ingestion(spark):
    wide = spark.createDataFrame([("a", 1.0, "No sabe"), ("b", float("nan"), " "), ("c", 99.0, None)], "k string, p1 double, p2 string")
    cells = ingest.unpivoted(wide, ["k"], ["p1", "p2"])
    questions = spark.createDataFrame([("p1", " ¿Uno? ", {"1": "Sí"}), ("p2", "Dos", {})], "codigo string, pregunta string, opciones map<string,string>")
    got = {(r["k"], r["codigo"]): (r["motivo"], r["texto"]) for r in ingest.answer_texts(cells, questions).collect()}
    assert got[("a", "p1")] == (None, "¿Uno? → Sí") and got[("c", "p1")][0] == "no_respuesta" and got[("a", "p2")][0] == "no_respuesta"
    assert got[("b", "p1")][0] == got[("b", "p2")][0] == got[("c", "p2")][0] == "vacia"
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (3, "d")], "k int, v string")
    filled, differ = ingest.completed(old, new, "k", ["v"])
    assert rows(filled) == [(1, "a"), (2, "c")] and rows(differ) == [(1, "v", "a", "b")]
    assert rows(ingest.upserted(old, new, ["k"])) == [(1, "b"), (2, "c"), (3, "d")]


def test_topics(spark):
    facts = spark.createDataFrame([("a", "t1", "x"), ("a", "t2", "x"), ("b", "t1", "x")], "p string, tema string, area string")
    assert {(r["tema"], r["personas"]) for r in topics.counts_by_topic_and_area(facts, "p").collect()} == {("t1", 2), ("t2", 1), (None, 2)}
    assert rows(topics.unused(spark.createDataFrame([("t1",), ("t9",)], "tema string"), facts)) == [("t9",)]


def test_marked_pairs(spark):
    questions = spark.createDataFrame([("a", {"1": "Sí", "2": "No"}), ("b", {"0": "", "1": "1"}), ("c", {}), ("d", {}), ("e", {"1": "Sí", "2": "No", "3": "?"}), ("f", {"1": "rojo", "2": "azul"})], "codigo string, opciones map<string,string>")
    values = spark.createDataFrame([("a", "1"), ("c", "0"), ("c", "1"), ("d", "1"), ("d", "7")], "codigo string, valor string")
    assert rows(profiling.marked_pairs(questions, values)) == [("a", "1", "2"), ("b", "1", "0"), ("c", "1", "0")]


def test_question_texts(spark):
    texts = ["P3. ¿Qué usa?? (Marque una respuesta)", "¿Qué usa?", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(profiling.cleaned_question(F.col("t"))).collect()]
    assert got == ["¿Qué usa?", "¿Qué usa?", None]


def test_masked_covers_national_numbers(spark):
    from cohortia.operators import profiling

    texts = spark.createDataFrame([("ci 1.234.567-2 y a@b.uy",), ("ci 1.234.567-3",), (None,)], "t string")
    assert [r["t"] for r in profiling.masked(texts, "t").collect()] == ["ci [cedula] y [correo]", "ci 1.234.567-3", None]


def test_people_by_topics_with_nulls(spark):
    facts = spark.createDataFrame([("p", "t1"), ("p", "t1"), ("q", "t2"), ("r", "t3"), ("s", None), (None, "t1")], "persona string, tema string")
    catalogue = spark.createDataFrame([("t1", "a", None), ("t2", "b", True), ("Té3", "b", False)], "tema string, area string, especial boolean")
    assert rows(topics.people_with(facts.filter("persona is not null"), catalogue, "persona", ids=["t1"], areas=["b"])) == [("p",)]
    assert rows(topics.people_with(facts.filter("persona is not null"), catalogue, "persona", areas=["b"], special=True)) == [("q",)]
    assert topics.people_with(facts.withColumn("tema", F.lit("Té3")), catalogue, "persona", names=["te3"], special=True).count() == 5
    assert topics.people_with(facts.limit(0), catalogue.limit(0), "persona", ids=["t1"]).count() == 0


def test_typed_identifiers(spark):
    people = spark.createDataFrame([("A", "D1", " X@y.z", "099123456"), ("B", "D2", None, "099 123 456"), ("C", None, "", None)], "id_persona string, documento string, email string, celular string")
    aliases = spark.createDataFrame([("o1", "ana", "A"), ("o2", "ana", "B"), ("o1", None, "C")], "origen string, alias string, id_persona string")
    asked = [("uuid", "C", None), ("documento", " D1 ", None), ("email", "x@Y.z", None), ("celular", "+598 99123456", None), ("alias", "ana", "o2"), ("alias", "ana", "o3"), ("email", "", None), ("otro", "x", None), (None, "x", None), ("uuid", None, None)]
    got = [(r["persona"], r["motivo"]) for r in identity.resolve_typed(spark.createDataFrame([(k, *x) for k, x in enumerate(asked)], "k int, tipo string, valor string, origen string"), people, aliases).orderBy("k").collect()]
    assert got == [("C", None), ("A", None), ("A", None), (None, "ambiguo"), ("B", None), (None, "desconocido"), (None, "vacio"), (None, "tipo_desconocido"), (None, "tipo_desconocido"), (None, "vacio")]


def test_ages_by_provenance(spark):
    from datetime import date

    people = spark.createDataFrame([("a", date(2000, 2, 29)), ("b", None), ("c", None), ("d", None)], "id_persona string, fecha_nacimiento date")
    t = datetime(2020, 1, 1)
    data = [(1, "b", 3, None, 30.0, None, date(2020, 6, 1), None, None, t), (2, "b", 2, 7, None, None, None, None, None, t), (3, "c", 2, 7, None, None, None, None, None, t), (4, "d", 2, 7, None, None, None, None, datetime(2021, 1, 1), t)]
    rows_ = spark.createDataFrame(data, "id long, id_persona string, atributo_id long, categoria_id long, valor_num double, valor_fecha date, fecha_referencia date, desde timestamp_ntz, hasta timestamp_ntz, actualizado_en timestamp_ntz")
    categories = spark.createDataFrame([(7, 2, "35-44")], "id long, atributo_id long, clave string")
    at = F.expr("timestamp_ntz '2025-02-28 00:00:00'")
    assert rows(segments.aged(people, rows_, categories, at, 3, 2)) == [("a", 24, "derivado", "18-24"), ("b", 34, "envejecido", "25-34"), ("c", None, "tramo_guardado", "35-44")]


def test_all_heavy_keys_are_found(spark):
    df = spark.range(6000).select((F.col("id") % 600).alias("k"))
    heavy = skew.heavy_keys(df, ["k"], 5)
    assert heavy.count == 600 and heavy.largest == 10 and heavy.only(df).count() == 6000 and heavy.without(df).count() == 0
    assert skew.heavy_keys(df, ["k"], 10) is None and skew.heavy_keys(df.limit(0), ["k"], 1) is None
