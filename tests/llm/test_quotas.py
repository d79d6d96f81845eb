"""Samples by quotas."""

import numpy as np
import pytest

from cohortia.llm import quotas

MEMBERS = "id long, panel_id long, id_persona string, estado string, sexo string"
PEOPLE = "id_persona string, sexo string, localidad string, edad int, tramo_etario string, panel_id long"
GOALS = "panel_id long, dimension string, categoria string, proporcion_objetivo double, n_muestra int, minimo_categoria int"


@pytest.mark.parametrize("seed", range(8))
def test_quotas_are_feasible_and_close(seed):
    rnd = np.random.default_rng(seed)
    cells = 40
    counts = rnd.integers(0, 60, cells)
    codes = [rnd.integers(0, 3, cells), rnd.integers(0, 5, cells)]
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.2, 0.2, 0.1, 0.1])]
    n = 200
    minima = [np.array([0, 0, 5]), np.array([0, 0, 0, 12, 0])]
    out = quotas.allocate(counts, codes, [s * n for s in shares], minima, n)
    assert out.sum() == min(n, counts.sum()) and (out <= counts).all() and (out >= 0).all()
    for code, least, share in zip(codes, minima, shares):
        have, got = np.bincount(code, counts, len(least)), np.bincount(code, out, len(least))
        assert (got >= np.minimum(least, have)).all()
        if (have > 2 * share * n).all():
            assert np.abs(got - share * n).max() <= 16
    assert quotas.allocate(np.zeros(3, int), [np.zeros(3, int)], [np.array([5.0])], [np.array([0])], 5).sum() == 0
    assert quotas.allocate(np.array([4, 4]), [np.array([0, 1])], [np.array([-1.0, -1.0])], [np.array([0, 0])], 20).tolist() == [4, 4]


def tables(spark):
    people = [(f"p{k}", "FM"[k % 2] if k % 11 else None, f"l{k % 4}", 30, "25-34" if k % 3 else "35-44", 9) for k in range(400)]
    members = [(k, 1, f"p{k}", "activo" if k % 5 else "baja", "x") for k in range(400)] + [(900 + k, 2, f"p{k}", "activo", "x") for k in range(3)]
    members += members[:50] + [(990, 1, f"p{k}", "activo", "x") for k in range(1, 4)] + [(991, 1, None, "activo", "x"), (992, None, "p1", "activo", "x"), (993, 3, "p1", "activo", "x"), (994, 1, "nadie", "activo", "x")]
    goals = [(1, "sexo", "F", 0.7, 60, 5), (1, "sexo", "M", 0.3, 60, 5), (1, "localidad", "l0", 0.5, 60, 5), (1, "localidad", "l9", 0.1, 60, 5), (2, "sexo", "F", 0.5, 10, 3), (1, "otra", "z", 0.1, 60, None), (7, "sexo", "F", 0.5, 10, 1)]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame(people + people[:9], PEOPLE), spark.createDataFrame(goals + goals[:2], GOALS)


def test_sample_follows_targets_and_reports(spark):
    members, people, goals = tables(spark)
    drawn, report = quotas.sample(members, people, goals)
    rows = drawn.collect()
    one = [r for r in rows if r["panel_id"] == 1]
    assert len(one) == 60 and len({r["id_persona"] for r in one}) == 60
    assert abs(sum(r["sexo"] == "F" for r in one) - 42) <= 1 and abs(sum(r["localidad"] == "l0" for r in one) - 30) <= 1
    assert len([r for r in rows if r["panel_id"] == 2]) == 3 and {r["panel_id"] for r in rows} == {1, 2}
    out = {(r["panel_id"], r["dimension"], r["categoria"]): r for r in report.collect()}
    assert out[1, "localidad", "l9"]["agotada"] and out[1, "localidad", "l9"]["disponibles"] == 0
    assert out[1, "sexo", "F"]["asignados"] == sum(r["sexo"] == "F" for r in one) and not out[1, "sexo", "F"]["agotada"]
    assert out[7, "sexo", "F"]["agotada"] and len(out) == 7
    assert sorted(r["id_persona"] for r in quotas.sample(members.repartition(13), people, goals)[0].collect()) == sorted(r["id_persona"] for r in rows)


def test_unmet_equals_a_plain_count(spark):
    members, people, goals = tables(spark)
    found = {(r["panel_id"], r["dimension"], r["categoria"]) for r in quotas.unmet(members, people, goals).collect()}
    active = {(m["panel_id"], m["id_persona"]) for m in members.collect() if m["estado"] == "activo"}
    values = {p["id_persona"]: p for p in people.collect()}
    want = set()
    for g in goals.collect():
        n = sum(pid == g["panel_id"] and who in values and g["dimension"] in ("sexo", "localidad", "tramo_etario") and values[who][g["dimension"]] == g["categoria"] for pid, who in active if who)
        if n < max(g["proporcion_objetivo"] * g["n_muestra"], g["minimo_categoria"] or 0):
            want.add((g["panel_id"], g["dimension"], g["categoria"]))
    assert found == want


def test_reservoirs_hold_the_lowest_hashes(spark):
    members, people, goals = tables(spark)
    held = quotas.held_reservoirs(members, people, quotas.clean_targets(goals)).filter("panel_id = 1").collect()
    for cell in {tuple(r[c] for c in quotas.CELL) for r in held}:
        own = [r for r in held if tuple(r[c] for c in quotas.CELL) == cell]
        assert len({r["n"] for r in own}) == 1 and [r["h"] for r in sorted(own, key=lambda r: r["rango"])] == sorted(r["h"] for r in own)


def test_empty_tables(spark):
    members, people, goals = tables(spark)
    assert quotas.sample(members.limit(0), people, goals)[0].count() == 0
    assert quotas.sample(members, people.limit(0), goals)[0].count() > 0
    assert quotas.unmet(members, people, goals.limit(0)).count() == 0
    assert quotas.unmet(members.limit(0), people, goals).count() == 7
