"""Attributes as known at events: the operator against a plain reading of its definition."""

import random
from datetime import datetime, timedelta

import pytest

from cohortia.operators.known_as_of import EARLIEST, Trees, as_known, floor_of, insert

ROWS = "id long, quien string, atributo int, valor string, desde timestamp_ntz, hasta timestamp_ntz, actualizado_en timestamp_ntz, t string"
EVENTS = "ev long, quien string, cuando timestamp_ntz, part string"
ZERO = datetime(2024, 1, 1)


def at(n):
    return None if n is None else ZERO + timedelta(hours=n)


def expected(events, rows):
    out = set()
    for ev, who, when, _ in events:
        if who is None or when is None:
            continue
        own = {r for r in rows if r[1] == who and r[2] is not None and r[6] is not None}
        for attribute in {r[2] for r in own}:
            mine = [r for r in own if r[2] == attribute]
            known = [r for r in mine if (r[4] is None or r[4] <= when) and r[6] <= when]
            if not known:
                continue
            best = max(known, key=lambda r: (r[4] or datetime.min, r[6], r[0]))
            later = any(r[4] == best[5] and r[6] > when for r in mine)
            if best[5] is None or best[5] > when or later:
                out.add((ev, attribute, best[0]))
    return out


def generated(seed, people=6, rows=120, events=60):
    rnd = random.Random(seed)
    hour = lambda: rnd.choice([None, *range(0, 40)])
    out = []
    for k in range(rows):
        start = hour()
        end = rnd.choice([None, start, (start or 0) + rnd.randint(0, 15)])
        out.append((k, f"p{rnd.randint(0, people)}" if rnd.random() > 0.03 else None, rnd.randint(1, 3), "x", at(start), at(end), at(rnd.choice([None] + list(range(45)) * 4)), "y"))
    out += out[:10]
    asked = [(k, f"p{rnd.randint(0, people)}" if rnd.random() > 0.05 else None, at(hour()), "z") for k in range(events)]
    return out, asked + asked[:5]


@pytest.mark.parametrize("floor", [20_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_definition(spark, seed, floor):
    rows, events = generated(seed)
    # repeated rows come unchanged, so equal ids mean equal rows
    found = as_known(spark.createDataFrame(events, EVENTS), spark.createDataFrame(rows, ROWS), "ev", "quien", "cuando", "quien", "atributo", floor=floor)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected(events, rows)


def test_carries_columns_and_bears_empty_tables(spark):
    rows, events = generated(3)
    r, e = spark.createDataFrame(rows, ROWS), spark.createDataFrame(events, EVENTS)
    found = as_known(e, r, "ev", "quien", "cuando", "quien", "atributo", carry=("valor", "t"))
    assert found.columns == ["ev", "atributo", "row_id", "valor", "t"]
    assert {x["valor"] for x in found.collect()} == {"x"}
    assert as_known(e.limit(0), r, "ev", "quien", "cuando", "quien", "atributo").count() == 0
    assert as_known(e, r.limit(0), "ev", "quien", "cuando", "quien", "atributo").count() == 0


def test_trees_keep_old_roots():
    roots, keys, rnd = [None], [], random.Random(5)
    for n in range(200):
        key = rnd.randint(0, 80)
        keys.append(key)
        roots.append(insert(roots[-1], key, n, hash((key, 1)) & 0xFFFF))
    for n, root in enumerate(roots):
        for asked in range(-1, 82, 7):
            below = [k for k in keys[:n] if k <= asked]
            found = floor_of(root, asked)
            assert (found[0] if found else None) == (max(below) if below else None)
            if found:
                assert found[1] == max(i for i, k in enumerate(keys[:n]) if k == found[0])


def test_an_end_that_was_not_known_yet_does_not_count():
    rows = [("a", 10, 1, None, 50, None, None), ("a", 90, 2, 50, None, None, None)]
    assert [(x[1][1][1], x[2]) for x in Trees(rows).known(60, False)] == [(1, True)]
    assert [(x[1][1][1], x[2]) for x in Trees(rows).known(95, False)] == [(2, True)]
    assert Trees(rows).of["a"][1][0][0] == EARLIEST
