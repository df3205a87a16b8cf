"""Token ids against the library's own, round trips of token files, and what a worker keeps."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import shared, tokens, word_tokens
from graphloom.llm.simple8b import read_file, write_file

PARTS = ["a", "b", "The", "'s", "'ll", "don't", "é", "ß", "日本", "Ω", "д", "½", "²", "x" * 70, " ", " ", " ", "  ", "\n", "\t", ".", "1", "4567", "!?", "<|endoftext|>", "\x00", "-", "_"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.vocabulary_path(), remembered=80_000)


def test_ids_equal_the_librarys(encoder):
    from tokenizers import Tokenizer

    witness = Tokenizer.from_file(tokens.vocabulary_path())
    assert witness.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    r = random.Random(3)
    texts = [None, "", " ", "a", "a <|endoftext|> b", "<|endoftext|>", *("".join(r.choice(PARTS) for _ in range(r.randint(1, 40))) for _ in range(3000))]
    for _ in range(2):  # the second time from memory, a part of which was forgotten
        ids, sizes = encoder.encode_all(pa.array(texts, pa.string()), 7)
        ends = np.cumsum(sizes)
        for text, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True):
            assert ids[a:b].tolist() == witness.encode(text or "", add_special_tokens=False).ids + [7]


def test_no_texts(encoder):
    ids, sizes = encoder.encode_all(pa.array([], pa.string()), 7)
    assert not len(ids) and not len(sizes)


@pytest.mark.parametrize("n", [0, 1, 3, 29, 30, 31, 65535, 65536, 65537, 200001])
@pytest.mark.parametrize("most", [2, 50, 50257, (1 << 32) - 1])
def test_token_file_round_trip(n, most):
    ids = (np.random.default_rng(n).random(n) ** 4 * most).astype(np.uint32)
    docs, lengths, back = read_file(write_file([1, None], np.array([n, 0]), ids))
    assert docs == [1, None] and lengths.tolist() == [n, 0] and back.tolist() == ids.tolist()


def test_a_worker_keeps_one_thing():
    made = []
    make = lambda: made.append(1) or len(made)
    assert [shared.kept("x", make), shared.kept("x", make), shared.kept("y", make), shared.kept("x", make)] == [1, 1, 2, 3]
    shared.release()
    assert not shared._kept


def test_strings_of_an_array_are_made_in_one_go():
    """Odd pieces come through, of a slice too, and what is remembered is weighed once."""
    pieces = ["", "a\x00b", "\x00", "\ufeffx", "é", "\U0001f600,", "z" * 70_000]
    array = pa.array(["before", *pieces, "behind"])
    assert word_tokens._strings(array.slice(1, len(pieces))) == pieces and word_tokens._strings(array.slice(0, 0)) == []
    memory = tokens._Memory(1 << 20)
    for upto in (3, 3, len(pieces) - 1):
        memory.young.update((p, p.encode()) for p in pieces[:upto])
        memory.age()
        assert memory.bytes == sum(sys.getsizeof(p) + sys.getsizeof(p.encode()) + tokens._PLACE for p in pieces[:upto])
