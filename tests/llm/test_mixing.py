"""Mixes of sources."""

import random
from fractions import Fraction
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortia.llm import mixing, tokens

needs_files = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary files")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 40), min_size=1).filter(lambda d: sum(d.values())))
def test_every_source_stays_within_a_block_of_its_share(counts):
    turns = mixing.pfair_turns(counts)
    total = sum(counts.values())
    assert [t for _, _, t in turns] == list(range(total))
    given_ = dict.fromkeys(counts, 0)
    for source, block, turn in turns:
        assert block == given_[source]
        given_[source] += 1
        for s, n in counts.items():
            assert abs(given_[s] - Fraction(n, total) * (turn + 1)) < 1
    assert given_ == counts


DOCS = "doc_id long, source string, text string, peso string"
GOAL = "source string, peso double, tope_repeticiones int, total_tokens long"


@needs_files
def test_mix_and_report(spark):
    docs = [(k, "a", "uno dos tres " * 5, "x") for k in range(40)] + [(100 + k, "b", "cuatro cinco", "x") for k in range(3)] + [(200, "c", None, "x"), (201, "c", "", "x"), (202, "otra", "fuera de la mezcla", "x"), (203, None, "sin fuente", "x")]
    goals = [("a", 0.5, 3, 1000), ("b", 0.3, 2, 1000), ("c", 0.1, 5, 1000), ("vacia", 0.1, 1, 1000), ("a", 0.5, 3, 1000)]
    d, g = spark.createDataFrame(docs, DOCS), spark.createDataFrame(goals, GOAL)
    mixed, report = mixing.mix(d, g, blocks=16)
    out = {r["source"]: r for r in report.collect()}
    assert set(out) == {"a", "b", "c", "vacia"}
    per = len(tokens.vocabulary(tokens.VOCABULARY).encode(["uno dos tres " * 5])[0])
    assert abs(out["a"]["mezclado"] - 500) <= per / 2 and not out["a"]["agotada"]
    assert out["b"]["agotada"] and out["b"]["mezclado"] == 2 * out["b"]["tokens"] and out["b"]["registros"] == 6
    assert out["c"]["tokens"] == 0 and out["c"]["agotada"] and out["vacia"]["mezclado"] == 0
    assert abs(sum(r["proporcion"] for r in out.values()) - 1) < 1e-9
    rows = mixed.collect()
    assert len({(r["doc_id"], r["repeticion"]) for r in rows}) == len(rows) and max(r["repeticion"] for r in rows) <= 2
    at = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["posicion"])):
        assert r["posicion"] == at.get(r["source"], 0)
        at[r["source"]] = r["posicion"] + r["n_tokens"]


@needs_files
def test_unmet_targets_and_empty_tables(spark):
    d, g = spark.createDataFrame([(1, "a", "uno dos", "x")], DOCS), spark.createDataFrame([("a", 1.0, 1, 100), ("b", 0.5, None, 100), ("c", None, 1, 100)], GOAL)
    found = mixing.mix(d, g)[1].filter("agotada")
    assert sorted(r["source"] for r in found.collect()) == ["a", "b"]
    mixed, report = mixing.mix(d.limit(0), g)
    assert mixed.count() == 0 and report.count() == 3
    assert mixing.mix(d, g.limit(0))[0].count() == 0


@needs_files
def test_no_prefix_of_the_mix_is_further_from_its_shares_than_the_bound(spark):
    rnd = random.Random(4)
    docs = [(k, rnd.choice("aaaabbc"), "uno dos " * rnd.choice([1, 1, 2, 5, 60]), "x") for k in range(400)]
    goals = [("a", 0.5, 3, 9000), ("b", 0.4, 4, 9000), ("c", 0.1, 1, 9000)]
    mixed, report = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(goals, GOAL))
    rows = sorted(mixed.collect(), key=lambda r: (r["turno"], r["posicion"]))
    out = {r["source"]: r for r in report.collect()}
    total, given_, worst = 0, dict.fromkeys("abc", 0), dict.fromkeys("abc", 0.0)
    for r in rows:
        total += r["n_tokens"]
        given_[r["source"]] += r["n_tokens"]
        for s in "abc":
            worst[s] = max(worst[s], abs(given_[s] - out[s]["proporcion"] * total))
    assert given_ == {s: out[s]["mezclado"] for s in "abc"}
    for s in "abc":
        assert worst[s] <= out[s]["desviacion"] + 1e-6 <= out[s]["cota"]
