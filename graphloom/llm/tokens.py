"""Token ids of whole texts with the tokenizers library.

A pre-token of the byte-level vocabulary never spans a space between other characters, so
a text is cut at its spaces and every different piece of a portion of texts (with the space
before it) is encoded on its own. A run of letters at the start of a piece is a pre-token
of its own, so pieces are parted in Arrow and runs are looked up apart from what follows
them; a worker remembers a bounded number of both. Runs not met before go to the
vocabulary's model many at a time: no merge joins two of them, and each begins with an id
that holds the space. Texts in which white space meets a space are
encoded as they are, because there the cut could matter, and so are texts that hold the
string of an added token, which the library finds before it cuts a text into pre-tokens.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept

#: Bytes that a worker spends on remembered pieces, in two generations; when the young one is full, the old one is forgotten.
REMEMBERED = 144 << 20
#: Bytes of a remembered piece beside its text and its ids: its place in a dict.
_PLACE = 100
#: Letters of which every version of Unicode says that they are letters, and runs of them before another ASCII character.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_RUN = re.compile(f"([{_LETTERS}]+)([\x00-\x40\x5b-\x60\x7b-\x7f].*)?", re.DOTALL)
#: The same for Arrow; where nothing follows, the second part is empty.
_PARTS = rf"(?s)^(?P<run>[{_LETTERS}]+)(?P<tail>[\x00-\x40\x5b-\x60\x7b-\x7f].*)?$"
_SIGNS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
#: Runs that go to the model at once, and the longest text that is remembered.
_AT_ONCE, _LONGEST = 64, 64
#: Bytes of text that are encoded together.
PORTION = 2 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _split(piece: str) -> tuple[str, str | None] | None:
    """The run of letters at the start of a piece and what follows it; None where another sign begins or follows it."""
    run = piece.rstrip(_SIGNS)
    if run.isascii() and run.isalpha():
        return run, piece[len(run) :]
    match = _RUN.fullmatch(piece)
    return match and match.groups()


class _Memory:
    """Ids of texts, in two generations; what is still used moves from the old to the young one."""

    def __init__(self, most: int) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.half = most // 2
        self.weighed = self.bytes = 0

    def age(self) -> None:
        """Weigh what came since the last call; past half of the bound, the young generation becomes the old one."""
        if more := len(self.young) - self.weighed:
            for new in (self.young, self.young.values()):
                self.bytes += sum(map(sys.getsizeof, islice(new, self.weighed, None)))
            self.bytes += more * _PLACE
            self.weighed += more
        if self.bytes >= self.half:
            self.young, self.old = {}, self.young
            self.weighed = self.bytes = 0

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found


class _Runs:
    """Ids of runs of letters: the runs as an Arrow array, their ids end to end; past a bound, those not met lately are forgotten."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.names, self.ids = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, bool)

    def age(self) -> None:
        """Past the bound, keep what was met since the last time, the latest half of the bound at most."""
        if self.names.nbytes + self.ids.nbytes + self.sizes.nbytes + self.met.nbytes <= self.most:
            return
        ends = np.cumsum(self.sizes)
        lengths = pc.binary_length(self.names).to_numpy()
        # a run takes its text and its offset, its ids, how many they are and whether it was met
        weights = np.where(self.met, lengths + 4 * self.sizes + 13, 0)
        keep = np.flatnonzero(self.met & (np.cumsum(weights[::-1])[::-1] <= self.most // 2))
        self.ids, _ = _spread(self.ids, ends - self.sizes, self.sizes, keep)
        self.names, self.sizes, self.met = self.names.take(pa.array(keep)), self.sizes[keep], np.zeros(len(keep), bool)

    def places(self, names: pa.StringArray, make: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where each of these different runs stands; `make` gives the ids of those not met before, end to end, and how many each has."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)
        self.met[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        if len(new):
            added = names.take(pa.array(new))
            ids, sizes = make(added)
            at[new] = len(self.names) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, added])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.ones(len(new), bool)])
        return at


def _spread(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the parts named by `at`, end to end, and where each ends; a part is `sizes` of `ids` from `begins` on."""
    widths = sizes[at]
    kind = np.int32 if int(widths.sum()) + len(ids) < 1 << 31 else np.int64
    widths = widths.astype(kind)
    ends = np.cumsum(widths, dtype=kind)
    place = np.repeat(begins.astype(kind)[at] - ends + widths, widths)
    place += np.arange(len(place), dtype=kind)
    return ids[place], ends


def _edged(pieces: pa.Array) -> np.ndarray:
    """Which pieces are empty or have white space at an end."""
    size = pc.binary_length(pieces).to_numpy()
    return (size == 0) | (size != pc.binary_length(pc.utf8_trim_whitespace(pieces)).to_numpy())


class Encoder:
    """encode_all gives the ids of many texts; a null text has none."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # runs take few bytes, but an index over them is made anew for every portion
        self.spaced, self.bare = _Runs(remembered // 9), _Memory(remembered * 3 // 4)
        # how the vocabulary writes a space and the letters
        written = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(" " + c)[0][0] for c in _LETTERS}
        self.alphabet = str.maketrans({c: w[1:] for c, w in written.items()} | {" ": written["A"][0]})
        mark, signs = written["A"][0], set("".join(written.values()))
        known = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(known.values(), default=0) + 1, bool)
        self.opens[[i for t, i in known.items() if t.startswith(mark)]] = True
        self.apart = not any(mark in t[1:] and signs.issuperset(t) for t in known)
        self.model = self.tokenizer.model

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _runs(self, runs: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each run of letters with a space before it, end to end, and how many each has."""
        cuts = [*range(0, len(runs), _AT_ONCE), len(runs)]
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), " ")
        out, sizes = [], []
        for text, n in zip(texts.to_pylist(), np.diff(cuts).tolist(), strict=True):
            ids = np.array([t.id for t in self.model.tokenize((" " + text).translate(self.alphabet))], "<u4") if self.apart else np.zeros(0, "<u4")
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == n:
                out.append(ids)
                sizes.append(np.diff(begins, append=len(ids)))
            else:
                each = [self.plain(" " + run) for run in text.split(" ")]
                out.append(np.frombuffer(b"".join(each), "<u4"))
                sizes.append(np.array([len(ids) >> 2 for ids in each]))
        return np.concatenate(out), np.concatenate(sizes)

    def _bare(self, text: str) -> bytes:
        """Ids of a text as it is, remembered if it is short."""
        if len(text) > _LONGEST:
            return self.plain(text)
        if (found := self.bare.get(text)) is None:
            found = self.bare.young[text] = self.plain(text)
        return found

    def pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these different pieces with a space before each, end to end, and how many each has; none has white space at an end."""
        self.spaced.age()
        self.bare.age()
        parts = pc.extract_regex(pieces, _PARTS)
        cut = parts.is_valid().to_numpy(zero_copy_only=False) & (pc.utf8_length(pieces).to_numpy() <= _LONGEST)
        parts = parts.filter(pa.array(cut))
        runs, tails = (parts.field(i).dictionary_encode() for i in (0, 1))
        at = self.spaced.places(runs.dictionary, self._runs)
        odd = pieces.filter(pa.array(~cut)).to_pylist()
        others = [self._bare(text) if text else b"" for text in tails.dictionary.to_pylist()] + [self._bare(" " + piece) for piece in odd] + [b""]
        # a piece is its run and what follows, or itself as it is and nothing
        n = len(self.spaced.names)
        two = np.full((len(pieces), 2), n + len(others) - 1)
        two[cut, 0] = at[runs.indices.to_numpy()]
        two[cut, 1] = n + tails.indices.to_numpy()
        two[~cut, 0] = n + len(tails.dictionary) + np.arange(len(odd))
        sizes = np.concatenate([self.spaced.sizes, np.fromiter(map(len, others), np.int64, len(others)) >> 2])
        known = np.concatenate([self.spaced.ids, np.frombuffer(b"".join(others), "<u4")])
        ids, ends = _spread(known, np.cumsum(sizes) - sizes, sizes, two.ravel())
        return ids, np.diff(ends[1::2].astype(np.int64), prepend=0)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit bytes."""
        return self.encode_all(pa.array([text], pa.string()), 0)[0][:-1].tobytes()

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's with end_id behind them, and how many ids each text has with it."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        table = split.flatten().dictionary_encode()
        offsets -= offsets[0]
        at = table.indices.to_numpy().copy()
        many = offsets[1:] - offsets[:-1]
        names = table.dictionary
        inner = np.ones(len(at), bool)
        inner[offsets[:-1]] = False
        # the first piece of a text has no space before it; the others that occur are looked up together
        used = np.zeros(len(names), bool)
        used[at[inner]] = True
        edged = _edged(names)
        wanted = np.flatnonzero(used & ~edged)
        ids, widths = self.pieces(names.take(pa.array(wanted)))
        owner = np.repeat(np.arange(n, dtype=np.int32), many)
        touching = np.zeros(n, bool)
        touching[owner[edged[at] & inner]] = True
        for token in self.added:
            touching |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        firsts = names.take(pa.array(at[offsets[:-1]])).to_pylist()
        touching |= np.array([first[-1:].isspace() for first in firsts]) & (many > 1)
        # a text in which white space meets a space, or with an added token's string, stands as a whole in place of its first piece
        opening = [self.plain(texts[d].as_py()) if whole else self._bare(first) if first else b"" for d, (first, whole) in enumerate(zip(firsts, touching.tolist(), strict=True))]
        at[offsets[:-1]] = len(names) + np.arange(n)
        at[touching[owner] & inner] = len(names) + n
        at = np.insert(at, offsets[1:], len(names) + n + 1)
        opening += [b"", np.array([end_id], "<u4").tobytes()]
        # the ids of every different piece once, and from there to each place where the piece stands
        sizes = np.zeros(len(names) + len(opening), np.int64)
        sizes[wanted] = widths
        sizes[len(names) :] = np.fromiter(map(len, opening), np.int64, len(opening)) >> 2
        ids, ends = _spread(np.concatenate([ids, np.frombuffer(b"".join(opening), "<u4")]), np.cumsum(sizes) - sizes, sizes, at)
        last = offsets[1:] + np.arange(n)  # where each text's end id came to lie among the pieces
        return ids, np.diff(ends[last].astype(np.int64), prepend=0)


def gathered(batches: Iterator[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches of less than `most` bytes joined until they hold as many: each portion costs an index over the known runs."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and (size >= most or batch.nbytes >= most):
            yield pa.concat_batches(held)
            held, size = [], 0
        if batch.nbytes >= most:
            yield batch
        else:
            held.append(batch)
            size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def portions(batch: pa.RecordBatch, column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(sizes):
        return
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for a worker's tasks in a row."""
    return kept(f"encoder {path} {remembered}", lambda: Encoder(path, remembered))


def ids_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4")
