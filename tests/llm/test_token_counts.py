"""The compiled tokenizer against the library it stands for."""

import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm.token_counts import Transducer, token_counts, with_token_counts
from tests.llm.fixtures import empty_documents, messy_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return Transducer(MODEL)


def expected(texts):
    return [len(LIBRARY.encode(t)) if t else 0 for t in texts]


def odd_texts():
    rng = random.Random(1)
    alphabets = ["ab ", "aeinrst ", " \n▁a1", "的一是不了在人有我他 ", "héèçàüößñ e", "=", "a", " ", "ab", "0123456789abcdef", "🙂é=- \t"]
    texts = ["".join(rng.choice(a) for _ in range(rng.choice([0, 1, 3, 40, 127, 128, 129, 300, 1000]))) for a in alphabets for _ in range(60)]
    return texts + [None, "", "<s>", "</s> <unk> <0x0A>", "\0a\0", "�", "a" * 5000, "ab" * 4000, " " * 3000, "▁x"]


@pytest.mark.parametrize("block", [1 << 20, 1000, 7])
def test_equals_the_library(machine, block):
    texts = odd_texts()
    assert token_counts(texts, machine, block).tolist() == expected(texts)


def test_states_thrown_away_between_blocks():
    machine = Transducer(MODEL, most_states=100)
    texts = odd_texts()
    assert token_counts(texts, machine, 777).tolist() == expected(texts)
    assert len(machine.states) < 5000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert token_counts(texts, _shared(), 64).tolist() == expected(texts)


def _shared(held=[]):
    if not held:
        held.append(Transducer(MODEL))
    return held[0]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = with_token_counts(docs, MODEL).collect()
    assert len(got) == docs.count() and [r.n_tokens for r in got] == expected([r.text for r in got])


def test_messy_and_empty(spark):
    docs = messy_documents(spark).withColumnRenamed("size", "n_tokens")
    got = with_token_counts(docs, MODEL).collect()
    assert len(got) == docs.count() and [r.n_tokens for r in got] == expected([r.text for r in got])
    assert set(got[0].asDict()) == set(docs.columns)
    assert with_token_counts(empty_documents(spark), MODEL).collect() == []
