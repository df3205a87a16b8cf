"""Token ids with a vocabulary of word ends that drops white space.

No pre-token spans a space and none depends on what stands beyond one, so a text is cut at
its spaces and every different piece is encoded on its own. Runs of letters not met before
go to the library many at a time: each is one pre-token, and its last id closes a word.
Pieces of ASCII letters with signs behind them, most of all, are parted in Arrow, so that only
different runs and what follows them are looked up.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept
from .tokens import _AT_ONCE, _LONGEST, _SIGNS, REMEMBERED, _Memory, _split

WORD_END = "</w>"


def _strings(texts: pa.StringArray) -> list[str]:
    """Strings of an array without nulls, made in one go and not by a scalar each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """encode_all gives the ids of many texts; a null text has none."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.tails = _Memory(remembered * 4 // 5), _Memory(remembered // 5)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _runs(self, runs: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(runs), _AT_ONCE):
            some = runs[i : i + _AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                out += [self.plain(run) for run in some]
        return out

    def _tail(self, text: str) -> bytes:
        if len(text) > _LONGEST:
            return self.plain(text)
        if (found := self.tails.get(text)) is None:
            found = self.tails.young[text] = self.plain(text)
        return found

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of these different pieces of texts."""
        self.known.age()
        self.tails.age()
        young, old = self.known.young, self.known.old
        found = list(map(young.get, pieces))
        runs: dict[str, bytes | None] = {}
        cut: list[tuple[int, str, str | None]] = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            if (ids := old.get(piece)) is not None:
                found[i] = young[piece] = ids
            elif len(piece) > _LONGEST:
                found[i] = self.plain(piece)
            elif split := _split(piece):
                run, tail = split
                ids = None if run in runs else self.known.get(run)
                if ids is None:
                    runs[run] = None
                    cut.append((i, run, tail))
                else:
                    found[i] = young[piece] = ids + (self._tail(tail) if tail else b"")
            else:
                found[i] = young[piece] = self.plain(piece)
        if runs:
            runs.update(zip(runs, self._runs(list(runs)), strict=True))
            young.update(runs)
        for i, run, tail in cut:
            found[i] = runs[run] + self._tail(tail) if tail else runs[run]
        return found

    def _known(self, runs: list[str]) -> list[bytes]:
        """Ids of each of these different runs of letters."""
        found = list(map(self.known.young.get, runs))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missing:
            found[i] = self.known.get(runs[i])
            if found[i] is None:
                new.append(i)
        for i, ids in zip(new, self._runs([runs[i] for i in new]), strict=True):
            found[i] = self.known.young[runs[i]] = ids
        return found

    def all_pieces(self, pieces: pa.StringArray) -> list[bytes]:
        """Ids of each of these different pieces of texts."""
        self.known.age()
        self.tails.age()
        run = pc.ascii_rtrim(pieces, characters=_SIGNS)
        plain = pc.and_(pc.ascii_is_alpha(run), pc.less_equal(pc.binary_length(pieces), _LONGEST))
        at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        runs = run.filter(plain).dictionary_encode()
        of_runs = self._known(_strings(runs.dictionary))
        out = [of_runs[i] for i in runs.indices.to_numpy().tolist()]
        whole = pieces.filter(plain)
        begins = pc.binary_length(runs.dictionary).to_numpy()[runs.indices.to_numpy()]
        more = np.flatnonzero(pc.binary_length(whole).to_numpy() > begins)
        for i, begin, text in zip(more.tolist(), begins[more].tolist(), _strings(whole.take(pa.array(more))), strict=True):
            out[i] += self._tail(text[begin:])
        if len(at) == len(pieces):
            return out
        odd = np.ones(len(pieces), bool)
        odd[at] = False
        found = np.empty(len(pieces), object)
        found[at] = out
        found[odd] = self.pieces(_strings(pieces.filter(pa.array(odd))))
        return found.tolist()

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's with end_id behind them, and how many ids each text has with it."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        table = split.flatten().dictionary_encode()
        ids = [*self.all_pieces(table.dictionary), np.array([end_id], "<u4").tobytes()]
        at = np.insert(table.indices.to_numpy(), offsets[1:], len(table.dictionary))
        # the ids of every different piece once, and from there to each place where the piece stands
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        kind = np.int32 if int(sizes[at].sum()) + int(sizes.sum()) < 1 << 31 else np.int64
        begins = (np.cumsum(sizes) - sizes).astype(kind)
        widths = sizes.astype(kind)[at]
        ends = np.cumsum(widths, dtype=kind)
        place = np.repeat(begins[at] - ends + widths, widths)
        place += np.arange(len(place), dtype=kind)
        last = offsets[1:] + np.arange(n)
        return np.frombuffer(b"".join(ids), "<u4")[place], np.diff(ends[last].astype(np.int64), prepend=0)


def word_encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """One encoder for a worker's tasks in a row."""
    return kept(f"word encoder {path} {remembered}", lambda: WordEncoder(path, remembered))
