"""Encoding against the installed library, and the round trip."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortia.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.VOCABULARY).exists(), reason="no vocabulary files")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HARD = ["'s", "'", "''re", "'ll'", "a", "é", " ", "  ", "\n", "\t", "1", "²", "٣", "!", "…", "'t", "ñ", " ", "​", "\x1c", "日", "🙂", "́", "'ve", "　", "\r\n", "<|endoftext|>"]


@pytest.fixture(scope="module")
def words():
    return tokens.vocabulary(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(words, texts):
    ids, bounds = words.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_equals_the_library(words, library):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(HARD, k=rnd.randint(0, 14))) for _ in range(5000)]
    assert encoded(words, texts) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=6))
def test_any_texts_equal_the_library_and_come_back(words, library, texts):
    got = encoded(words, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [words.decode(x) for x in got] == texts


def test_long_texts(words, library):
    for text in ["x" * 5000, "ab" * 3000, " " * 4000, "é" * 3000, "palabra " * 90_000]:
        assert encoded(words, [text, "y"]) == [library.encode_ordinary(text), library.encode_ordinary("y")]


def test_scan_equals_the_step_by_step_states(words):
    cls = np.random.default_rng(0).integers(0, 9, 1000).astype(np.uint8)
    state, out = tokens.FRESH, []
    for c in cls:
        out.append(state)
        state = tokens._STEP[int(c) * tokens.STATES + state]
    assert tokens.states_before(cls).tolist() == out


def test_operator_on_hard_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "   ", None), (4, "it's 10 %", "k"), (4, "it's 10 %", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "byte_fin x.y")
    out = tokens.encode_texts(df, byte_ends="ends")
    assert out.columns == ["doc_id", "byte_fin x.y", "ids", "ends"]
    got = sorted((r["doc_id"], list(r["ids"]), list(r["ends"])) for r in out.collect())
    assert got[0] == (1, [], []) and got[1] == (2, [], []) and len(got) == 5 and got[3] == got[4]
    assert got[3][2][-1] == len("it's 10 %") and got[2][1]
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(out).collect()}
    assert back[4] == "it's 10 %" and back[1] == ""
    assert tokens.encode_texts(df.limit(0)).count() == 0
    clash = tokens.encode_texts(spark.createDataFrame([(1, "a", "old")], "doc_id long, text string, ids string"))
    assert clash.columns == ["doc_id", "ids"] and list(clash.first()["ids"]) == [64]
    assert sorted(r["n_tokens"] for r in tokens.count_tokens(df).collect()) == sorted(len(x[1]) for x in got)
