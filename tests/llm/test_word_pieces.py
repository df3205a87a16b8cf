"""Pieces that are parted in Arrow have the ids that the library gives them."""

import pyarrow as pa

from graphloom.llm.tokens import vocabulary_path
from graphloom.llm.word_tokens import WordEncoder


def test_parted_pieces_against_the_library():
    encoder = WordEncoder(vocabulary_path("word_bpe_49k.json"))
    pieces = ["", "word", "word.", "word,\n", "Word", "don't", "a1b", "123", "\t", "é", "café.", "x\x00", "word\n\nword", "naïve-ish", "日本", "w" * 70, "w" * 60 + "." * 9, "end</w>", "--", "q?!"]
    for _ in range(2):
        assert encoder.all_pieces(pa.array(pieces)) == [encoder.plain(p) for p in pieces]
    # a run is remembered once, whatever follows it
    assert "word" in encoder.known.young and not {"word.", "word,\n", "q?!"} & set(encoder.known.young)
    assert encoder.all_pieces(pa.array([], pa.string())) == []
