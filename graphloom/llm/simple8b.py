"""Token-id files: Simple-8b word-aligned coding.

A word of 64 bits holds a 4-bit selector and 60 bits of codes; the selector says how many
codes of which width. A code of all ones is an escape: the id follows in the block's list
of escaped ids. Each file first ranks its ids by frequency, so that codes are small. Ids
lie in blocks; the offset of each block is kept, so blocks can be decoded apart.

File: magic `GLS8`, version, counts (`<IQQII`: version, documents, ids, distinct ids,
blocks); document ids (int64, the least int64 for null); ids per document (uint32);
distinct ids in rank order (uint32); block table (uint64 byte offset in the payload,
uint32 ids, uint32 words, uint32 escapes); payload: per block its words, then its escapes
(uint32). All little-endian.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"GLS8"
BLOCK_IDS = 1 << 16
#: Fixed values of the format: width of a code and codes per word for selectors 0 to 9.
WIDTHS = (2, 3, 4, 5, 6, 7, 10, 12, 15, 30)
COUNTS = (30, 20, 15, 12, 10, 8, 6, 5, 4, 2)
#: Escapes that a word may hold before a wider selector is taken.
ALLOWED = (3, 2, 2, 1, 1, 1, 1, 0, 0, 0)
NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIQQII")
_BLOCK = np.dtype([("offset", "<u8"), ("ids", "<u4"), ("words", "<u4"), ("escapes", "<u4")])


def encode_block(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words and the escaped codes of a block of unsigned 32-bit codes."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    pick = np.full(n, len(WIDTHS) - 1, np.int8)
    narrow = codes.astype(np.uint16) if int(codes.max()) < 1 << 16 else codes
    for s in range(len(WIDTHS) - 2, -1, -1):
        # differences of a running count are right in 16 bits, for no word holds that many codes
        over = np.zeros(n + COUNTS[s] + 1, np.uint16)
        np.cumsum(narrow >= (1 << WIDTHS[s]) - 1, dtype=np.uint16, out=over[1 : n + 1])
        over[n + 1 :] = over[n]
        np.copyto(pick, s, where=over[COUNTS[s] : COUNTS[s] + n] - over[:n] <= ALLOWED[s])
    # where the next word starts, and from there the fourth; four runs of starts are walked as one
    step = np.full(n + 1, n)
    step[:n] = np.minimum(np.arange(n) + np.asarray(COUNTS)[pick], n)
    second = step[step]
    fourth = memoryview(second[second])
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = fourth[i]
    first = np.asarray(starts)
    at = np.stack([first, step[first], second[first], step[second[first]]], 1).ravel()
    at = at[at < n]
    selector = pick[at].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    escaped = np.zeros(n, bool)
    padded = np.zeros(n + COUNTS[0], np.uint64)
    padded[:n] = codes
    for s, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        own = np.flatnonzero(selector == s)
        if not len(own):
            continue
        # a row for each place in a word, so that words lie along the long axis
        place = at[own] + np.arange(count)[:, None]
        values = padded[place]
        top = np.uint64((1 << width) - 1)
        big = values >= top
        escaped[place[big]] = True
        values[big] = top
        words[own] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(width))[:, None], axis=0)
    return words, codes[escaped].astype(np.uint32)


def decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The codes of a block: whole columns of equal selectors at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(np.asarray(COUNTS)[selector]) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(n + COUNTS[0], np.uint32)
    escaped = np.zeros(n + COUNTS[0], bool)
    for s, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        own = np.flatnonzero(selector == s)
        if not len(own):
            continue
        top = np.uint64((1 << width) - 1)
        values = (words[own][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(width))) & top
        place = (ends[own] - count)[:, None] + np.arange(count)
        keep = place < n
        out[place[keep]] = values[keep]
        escaped[place[keep]] = values[keep] == top
    out, escaped = out[:n], escaped[:n]
    out[escaped] = escapes
    return out


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() < 1 << 22:  # by counting; any larger ids by sorting
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        order = np.argsort(-counts[distinct], kind="stable")
        rank = np.zeros(len(counts), np.uint32)
        rank[distinct[order]] = np.arange(len(order), dtype=np.uint32)
        codes = rank[ids]
    else:
        distinct, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.zeros(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        codes = rank[inverse]
    table, payload, offset = [], [], 0
    for i in range(0, len(codes), BLOCK_IDS):
        part = codes[i : i + BLOCK_IDS]
        words, escapes = encode_block(part)
        table.append((offset, len(part), len(words), len(escapes)))
        payload += [words.astype("<u8").tobytes(), escapes.astype("<u4").tobytes()]
        offset += len(payload[-1]) + len(payload[-2])
    head = _HEAD.pack(MAGIC, 1, len(doc_ids), len(ids), len(distinct), len(table))
    named = np.array([NULL_ID if x is None else x for x in doc_ids], "<i8")
    return b"".join([head, named.tobytes(), np.asarray(lengths, "<u4").tobytes(), distinct[order].astype("<u4").tobytes(), np.array(table, _BLOCK).tobytes(), *payload])


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, all ids."""
    magic, version, n_docs, n_ids, n_distinct, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token-id file of version 1")
    at = _HEAD.size
    parts = []
    for kind, count in (("<i8", n_docs), ("<u4", n_docs), ("<u4", n_distinct), (_BLOCK, n_blocks)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    named, lengths, distinct, table = parts
    codes = np.empty(n_ids, np.uint32)
    done = 0
    for offset, count, words, escapes in table.tolist():
        w = np.frombuffer(data, "<u8", words, at + offset)
        e = np.frombuffer(data, "<u4", escapes, at + offset + 8 * words)
        codes[done : done + count] = decode_block(w, e, count)
        done += count
    return [None if x == NULL_ID else x for x in named.tolist()], lengths, distinct[codes] if n_ids else codes
