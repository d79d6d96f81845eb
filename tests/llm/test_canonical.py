"""Typed values and reference entries."""

import random

import pytest

from cohortia.llm.typed import bounded_distance, folded, weighted_distance
from cohortia.llm import canonical

ENTRIES = [(1, "Puerto Almeja", 5), (2, "Puerto Almena", 9), (3, "Villa Cendal", 1), (4, "San Aurelio", 1), (5, "Santa Aurelia", 1), (6, "La Cimbrada", 1), (7, "Monte Larguero", 1), (8, "Bañado Grande", 1), (9, "Maestro de escuela", 1), (10, "Peón rural", 1)]


@pytest.fixture(scope="module")
def reference():
    return canonical.Reference(ENTRIES)


@pytest.mark.parametrize(
    "typed,entry",
    [("Pto. Almeja", 1), ("PUERTO ALMENA", 2), ("S. Aurelio", 4), ("Sta Aurelia", 5), ("vivo en la cimbrada", 6), ("Larguero", 7), ("montelarguero", 7), ("BaÃ±ado Gde", 8), ("Cendal Villa", 3), ("Villa Cenda", 3), ("mtra. escuela", 9), ("peón de campo rural", 10)]
    + [(t, 0) for t in ("", "   ", "???", "n/c", "Xantofil", "escuela de magia", "Curso de manejo", "99", "Aldea Gromov")],
)
def test_meant_entries(reference, typed, entry):
    assert reference.best(typed)[0] == entry


def test_dictionary_finds_what_a_scan_finds(reference):
    rnd = random.Random(4)
    for _ in range(400):
        s = list(rnd.choice(ENTRIES)[1].lower())
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(s))
            s[k : k + 1] = rnd.choice(["", rnd.choice("aeiourstnl "), s[k] * 2])
            s = s or ["a"]
        value = "".join(s)
        assert reference.best(value)[0] == reference.best_by_scan(value), value


def test_deletions_meet_within_the_bound():
    rnd = random.Random(5)
    for _ in range(300):
        a = "".join(rnd.choices("abc", k=rnd.randint(3, 9)))
        b = "".join(rnd.choices("abc", k=rnd.randint(3, 9)))
        k = 2
        if bounded_distance(a, b, k) <= k:
            assert canonical.deletions(a, k) & canonical.deletions(b, k)


def test_distances():
    assert [bounded_distance("casa", x, 2) for x in ("casa", "caas", "cas", "perro", "")] == [0, 1, 1, 3, 3]
    assert weighted_distance("casa", "caza", 2) < weighted_distance("casa", "capa", 2)
    assert weighted_distance("abc", "xyzzy", 1) == 2 and folded("  Ñandú_ÁRBOL, 3º ") == "nandu arbol 3o"


def test_operator_on_hard_rows(spark):
    rows = spark.createDataFrame(
        [(1, 4, None, "pto almeja", "x"), (1, 4, None, "pto almeja", "x"), (2, 4, None, None, "x"), (3, 4, 2, "Puerto Almena", "x"), (4, 4, None, "", "x"), (5, 77, None, "Puerto Almeja", "x"), (6, None, None, "Puerto Almeja", "x"), (7, 4, None, "z" * 200_000, "x")],
        "id long, atributo_id long, categoria_id long, valor_crudo string, costo string",
    )
    entries = spark.createDataFrame([(i, 4, e) for i, e, _ in ENTRIES] + [(1, 4, "Puerto Almeja"), (None, 4, "x"), (50, 4, None)], "id long, atributo_id long, etiqueta string")
    mapped = canonical.map_values(rows, entries)
    assert sorted((r["id"], r["categoria_id"]) for r in mapped.collect()) == [(1, 1), (4, 0), (5, 0), (6, 0), (7, 0)]
    assert {(r["atributo_id"], r["filas"]) for r in canonical.misses(mapped).collect()} == {(4, 1), (77, 1), (None, 1)}
    assert canonical.map_values(rows.limit(0), entries).count() == 0
    assert {r["categoria_id"] for r in canonical.map_values(rows, entries.limit(0)).collect()} == {0}


def test_long_values_without_spaces_are_found():
    list_ = canonical.Reference([(1, "Facultad de Ciencias Económicas y Administración", 0), (2, "Facultad de Ciencias", 0)])
    assert list_.best("facultaddecienciaseconomicasyadministracion")[0] == 1
    assert list_.best("facultaddecienciaseconomicasyadminstracoin")[0] == 1
    assert list_.best("x" * 5000)[0] == 0
