"""Histories against a sequential reading of their definition."""

import json
import random
from datetime import date, datetime, timedelta

import pytest

from cohortia.operators import attribute_history as history

ROWS = "id long, id_persona string, atributo_id long, categoria_id long, valor_num double, valor_fecha date, valor_crudo string, desde timestamp_ntz, hasta timestamp_ntz, actualizado_en timestamp_ntz, orden string, fin string"
LOG = "id long, atributo_id long, clave string, accion string, detalle string, actor_uid string, creado_en timestamp_ntz, estado string"
ZERO = datetime(2024, 1, 1)


def text(t):
    return "-" if t is None else t.strftime("%Y-%m-%d %H:%M:%S")


def versions_of_rows(rows):
    groups = {}
    for r in set(rows):
        if r[1] is not None and r[2] is not None and any(v is not None for v in r[3:6]):
            groups.setdefault((r[1], r[2]), []).append(r)
    out = []
    for (who, attribute), own in groups.items():
        held = {}
        for r in sorted(own, key=lambda r: (r[9] or datetime.min, r[0])):
            held[r[7]] = r
        starts = sorted(held, key=lambda t: t or datetime.min)
        done = []
        for k, start in enumerate(starts):
            r = held[start]
            ends = [t for t in (r[8], starts[k + 1] if k + 1 < len(starts) else None) if t is not None]
            end = min(ends) if ends else None
            if start is not None and end is not None and end <= start:
                continue
            if done and done[-1][2] == r[3:6] and done[-1][1] is not None and done[-1][1] == start:
                done[-1][1] = end
            else:
                done.append([start, end, r[3:6]])
        out += [(who, str(attribute), text(a), text(b)) for a, b, _ in done]
    return sorted(out)


def versions_of_log(log):
    out = []
    for key in {e[2] for e in log if e[2] is not None and e[6] is not None}:
        used, label, open_ = False, None, None
        entries = sorted({e for e in log if e[2] == key and e[6] is not None}, key=lambda e: (e[6], e[0]))
        states = {}
        for e in entries:
            used = True if e[3] in ("alta", "reactivacion") else False if e[3] in ("desactivacion", "baja") else used
            if e[3] in ("alta", "edicion"):
                d = json.loads(e[4])
                label = d.get("cambios", {}).get("etiqueta", {}).get("despues") or d.get("etiqueta") or label
            states[e[6]] = (used, label)
        for t, (u, lab) in states.items():
            if open_ and (not u or lab != open_[1]):
                out.append(("catalogo", key, text(open_[0]), text(t)))
                open_ = None
            if u and not open_:
                open_ = (t, lab)
        if open_:
            out.append(("catalogo", key, text(open_[0]), "-"))
    return sorted(out)


def generated(seed):
    rnd = random.Random(seed)
    when = lambda: rnd.choice([None] + [ZERO + timedelta(days=n) for n in range(25)] * 3)
    rows = []
    for k in range(300):
        a = when()
        end = rnd.choice([None, a, (a or ZERO) + timedelta(days=rnd.randint(0, 9))])
        value = rnd.choice([(None, None, None), (1, None, None), (2, None, None), (None, 1.0, None), (None, None, date(2020, 1, rnd.randint(1, 2)))])
        rows.append((k, rnd.choice([None, "a", "b", "c", "d"]), rnd.choice([None, 1, 2, 3]), *value, "x", a, end, when(), "clash", "clash"))
    log, actions = [], ["alta", "edicion", "desactivacion", "reactivacion", "baja", "categoria", "recalculo"]
    for k in range(120):
        detail = rnd.choice(["{}", json.dumps({"etiqueta": rnd.choice("AB")}), json.dumps({"cambios": {"etiqueta": {"antes": "A", "despues": rnd.choice("ABC")}}}), json.dumps({"cambios": {"orden": {"antes": 1, "despues": 2}}})])
        log.append((k, None, rnd.choice([None, "k1", "k2", "k3"]), rnd.choice(actions), detail, None, when(), "clash"))
    return rows + rows[:20], log + log[:9]


@pytest.mark.parametrize("floor", [20_000, 4])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_versions_equal_the_definition(spark, seed, floor):
    rows, log = generated(seed)
    found = history.all_versions(spark.createDataFrame(rows, ROWS), spark.createDataFrame(log, LOG), floor)
    got = sorted(tuple(r) for r in found.collect())
    assert [g for g in got if g[0] != "catalogo"] == versions_of_rows(rows)
    assert [g for g in got if g[0] == "catalogo"] == versions_of_log(log)


def test_empty_tables(spark):
    assert history.all_versions(spark.createDataFrame([], ROWS), spark.createDataFrame([], LOG)).count() == 0


def test_satellites_are_split_by_rate(spark):
    rows = [(k, "a", 1, k, None, None, None, ZERO + timedelta(days=k), None, ZERO, "", "") for k in range(5)] + [(9, "a", 2, 1, None, None, None, None, None, ZERO, "", "")]
    table = spark.createDataFrame(rows, ROWS)
    split = {(r["atributo_id"], r["satelite"]) for r in history.split_by_rate(history.together(history.satellite_of_rows(table)), history.rates(table)).collect()}
    assert split == {(1, "rapido"), (2, "lento")}


def test_a_snapshot_appends_only_changes(spark):
    first = spark.createDataFrame([("a", "x", ZERO), ("b", "x", ZERO), ("c", None, ZERO)], "k string, v string, t timestamp_ntz")
    empty = spark.createDataFrame([], "k string, cambio timestamp_ntz, hash_diff string, v string")
    satellite = history.append_changes(empty, first, ["k"], ["v"], "t")
    assert satellite.count() == 3
    later = ZERO + timedelta(days=1)
    second = spark.createDataFrame([("a", "x", later), ("b", "y", later)], "k string, v string, t timestamp_ntz")
    added = {(r["k"], r["cambio"], r["v"], r["hash_diff"] is None) for r in history.append_changes(satellite, second, ["k"], ["v"], "t").collect()}
    assert added == {("b", later, "y", False), ("c", later, None, True)}
