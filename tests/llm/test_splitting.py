"""Pieces of long texts."""

import random
from pathlib import Path

import pytest

from cohortia.llm import splitting, tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def words():
    return tokens.vocabulary(tokens.VOCABULARY)


def texts():
    rnd = random.Random(2)
    parts = ["la casa", "el precio sube", "no, gracias", "¿y si no?", "una fila: dos", "\n\n", "\n", ". ", "; ", "x" * 30, "🙂", "é", " "]
    return ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(50, 900))) for _ in range(25)] + ["a" * 3000, "🙂" * 900, "\n" * 2500, "a b" * 2000, "é" * 2500]


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 8), (30, 0)])
def test_pieces_cover_the_text_within_the_limit(words, limit, overlap):
    splitter = splitting.Splitter(words, limit, overlap)
    for text, found in zip(texts(), splitter.split_all(texts())):
        ids = words.encode([text])[0].tolist()
        assert found[0][1] == 0 and found[-1][2] == len(ids)
        assert all(a[2] == b[1] for a, b in zip(found, found[1:]))
        for back, start, end, a, b, _ in found:
            assert end - back <= limit and len(words.encode([text[a:b]])[0]) <= limit
            assert back == 0 if not start else min(start, overlap) <= start - back <= min(start, overlap + 3)
        if len(ids) > limit:
            for x, y in zip(found, found[1:]):  # no two neighbours would fit together
                assert y[2] - x[0] > limit - 8


def test_cuts_at_the_strongest_pauses(words):
    paragraph = "Una frase corta. Otra frase, con coma; y más. " * 2
    text = ("\n\n".join([paragraph] * 12)).strip()
    splitter = splitting.Splitter(words, 90, 8)
    assert {f[5] for f in splitter.split(text)[:-1]} == {"parrafo"}


def test_weaker_boundaries_go_first(words):
    text = "uno dos tres, cuatro cinco seis. siete ocho nueve, diez once doce. " * 3
    kinds = [f[5] for f in splitting.Splitter(words, 30, 0).split(text)[:-1]]
    assert set(kinds) == {"oracion"}


def test_operator_on_hard_rows(spark):
    long_ = "palabra " * 700
    rows = [(1, None, 7), (2, "", 7), (3, "corto", 7), (4, long_, None), (4, long_, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieza int")
    every = splitting.split_texts(df)
    assert every.columns == ["doc_id", "pieza", "n_piezas", "token_solape", "token_ini", "token_fin", "n_tokens", "char_ini", "char_fin", "corte", "tokens_texto", "texto"]
    got = every.collect()
    assert {r["doc_id"] for r in got} == {3, 4} and max(r["n_tokens"] for r in got) <= 512
    assert {r["doc_id"] for r in splitting.split_texts(df, only_long=True).collect()} == {4}
    assert splitting.split_texts(df.limit(0)).count() == 0
    pieces = sorted({(r["pieza"], r["char_ini"], r["char_fin"], r["texto"]) for r in got if r["doc_id"] == 4})
    assert all(t == long_[a:b] for _, a, b, t in pieces) and pieces[0][1] == 0 and pieces[-1][2] == len(long_)
