"""Runs of letters and what follows them are looked up and remembered apart, within a bound."""

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm.tokens import Encoder, gathered, vocabulary_path

RUNS = ["alpha", "Betagamma", "été", "Straße", "deltaepsilon"]
TAILS = ["", ",", ".\nThe", "!?", "'s", "123", ".é", "\x00", "-日本"]


@pytest.fixture(scope="module")
def witness():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def same(encoder, witness, texts):
    ids, sizes = encoder.encode_all(pa.array(texts, pa.string()), 7)
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
        assert ids[a:b].tolist() == witness.encode(text, add_special_tokens=False).ids + [7]


def test_a_run_is_known_once_whatever_follows_it(witness):
    encoder = Encoder(vocabulary_path())
    texts = ["x " + " ".join(run + tail for run in RUNS for tail in TAILS)] * 3
    for _ in range(2):
        same(encoder, witness, texts)
    # 45 different pieces, but five runs and eight tails, and the piece that opens a text
    assert sorted(encoder.spaced.names.to_pylist()) == sorted(RUNS)
    assert set(encoder.bare.young) == {*TAILS[1:], "x"}


def test_runs_are_forgotten_and_come_back(witness):
    encoder = Encoder(vocabulary_path(), remembered=36_000)
    words = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(0, 26**4, 900)]
    most = 0
    for i in [*range(0, len(words), 50), *range(0, len(words), 50)]:
        same(encoder, witness, ["a " + " ".join(words[i : i + 50] + words[:5])])
        most = max(most, len(encoder.spaced.names))
    assert 50 < most < len(words)
    # what every text holds was never forgotten
    assert set(words[:5]) <= set(encoder.spaced.names.to_pylist())


def test_one_long_text_past_the_bound(witness):
    encoder = Encoder(vocabulary_path(), remembered=900)
    texts = ["a " + " ".join(f"{'bcdfg'[i % 5]}{'aeiou'[i // 5 % 5]}{'lmnrs'[i // 25 % 5]}{'aeiou'[i // 125 % 5]}," for i in range(625))] * 2
    for _ in range(3):
        same(encoder, witness, texts)


def test_small_batches_are_encoded_together():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([None, *(f"text {i}" for i in range(999))])], names=["id", "text"])
    pieces = [batch.slice(i, 10) for i in range(0, 1000, 10)]
    for most in (1, 5000, 1 << 20):
        got = list(gathered(iter(pieces), most))
        assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
        assert all(b.nbytes >= most for b in got[:-1])
    assert len(got) == 1 and not list(gathered(iter([])))
