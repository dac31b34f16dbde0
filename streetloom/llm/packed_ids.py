"""Simple-8b with block offsets: token ids in 64-bit words whose upper four bits say how many ids of which width follow.

A block holds up to BLOCK ids and starts at a known word, so blocks are packed and unpacked side by side with array
operations. Ids of 60 bits or more are escapes: selector 15 keeps the lower 60 bits, and the upper four follow after the words, in order.

A file, all numbers little-endian: MAGIC; five u64 (documents, ids, blocks, words, escapes); i64 document ids; u8 flags (1: the document
has no id); u64 ids per document; u64 first word of each block, and the number of words; the words; u8 upper parts of escapes; u32 crc32 of all before."""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"S8BTOK1\n"
BLOCK = 4096
RUN = 64 * BLOCK
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
COUNTS = np.array([n for n, _ in SELECTORS] + [0, 1], dtype=np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block with the total at the end, upper parts of escapes. Goes in runs of whole blocks, so that the working
    arrays are bounded."""
    if not len(ids):
        return np.empty(0, "<u8"), np.zeros(1, "<u8"), np.empty(0, np.uint8)
    runs = [pack_run(np.ascontiguousarray(ids[s : s + RUN], dtype=np.uint64)) for s in range(0, len(ids), RUN)]
    begins = np.cumsum([0, *(len(w) for w, _, _ in runs)]).astype("<u8")
    offsets = np.concatenate([o[:-1] + b for (_, o, _), b in zip(runs, begins, strict=False)] + [begins[-1:]])
    return np.concatenate([w for w, _, _ in runs]), offsets.astype("<u8"), np.concatenate([u for _, _, u in runs])


def pack_run(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    # A word that fits with a narrow selector also fits with each wider one, which takes fewer ids: so only the positions that
    # the last selector took are tried with the next.
    at_all = np.arange(n)
    last = np.minimum(np.arange(blocks) * BLOCK + BLOCK, n)
    choice = np.full(n, ESCAPE, dtype=np.int8)
    left = (last.repeat(BLOCK)[:n] - at_all).astype(np.int32)
    fits, top = at_all, int(ids.max())
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        fits = fits[left[fits] >= count]
        if top >> width:
            wide = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(ids >> np.uint64(width) != 0, out=wide[1:])
            fits = fits[wide[fits + count] == wide[fits]]
        if not len(fits):
            break
        choice[fits] = s
    jump = COUNTS[choice]
    at, live, begins = np.arange(blocks) * BLOCK, np.arange(blocks), np.zeros(n, dtype=bool)
    while len(live):
        begins[at[live]] = True
        at[live] += jump[at[live]]
        live = live[at[live] < last[live]]
    start = np.flatnonzero(begins)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(start // BLOCK, minlength=blocks))))
    selector = choice[start].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.nonzero(selector == s)[0]
        if len(mine):
            parts = ids[start[mine][:, None] + np.arange(count)] << (np.arange(count) * width).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(parts, axis=1)
    large = ids[start[selector == ESCAPE]]
    words[selector == ESCAPE] |= large & np.uint64((1 << 60) - 1)
    return words.astype("<u8"), offsets.astype("<u8"), (large >> np.uint64(60)).astype(np.uint8)


def unpack(words: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The ids of any run of whole blocks; ``upper`` are the upper parts of the escapes among them."""
    words = words.astype(np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), dtype=np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.nonzero(selector == s)[0]
        if len(mine):
            parts = words[mine][:, None] >> (np.arange(count) * width).astype(np.uint64)
            ids[first[mine][:, None] + np.arange(count)] = parts & np.uint64((1 << width) - 1)
    large = selector == ESCAPE
    ids[first[large]] = words[large] & np.uint64((1 << 60) - 1) | upper.astype(np.uint64) << np.uint64(60)
    return ids


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, upper = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets) - 1, len(words), len(upper)], dtype="<u8")
    body = b"".join((
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.asarray(lengths, dtype="<u8").tobytes(), offsets.tobytes(), words.tobytes(), upper.tobytes()))
    return body + zlib.crc32(body).to_bytes(4, "little")


def from_bytes(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document and all ids; raises ValueError for what is not a whole file."""
    if data[:8] != MAGIC or zlib.crc32(memoryview(data)[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a whole file of packed ids")
    docs, n, blocks, n_words, escapes = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
    at = 48
    numbers, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
    none, at = np.frombuffer(data, np.uint8, docs, at), at + docs
    lengths, at = np.frombuffer(data, "<u8", docs, at).astype(np.int64), at + 8 * docs
    at += 8 * (blocks + 1)
    words, at = np.frombuffer(data, "<u8", n_words, at), at + 8 * n_words
    ids = unpack(words, np.frombuffer(data, np.uint8, escapes, at))
    if len(ids) != n:
        raise ValueError("packed ids and header differ")
    return [None if z else int(d) for d, z in zip(numbers, none, strict=True)], lengths, ids


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, by its offset alone; no other words are unpacked."""
    docs, _, blocks, n_words, escapes = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
    at = 48 + 17 * docs
    offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * (blocks + 1))
    before = int(np.count_nonzero(words[: offsets[block]] >> np.uint64(60) == ESCAPE)) if escapes else 0
    mine = words[offsets[block] : offsets[block + 1]]
    upper = np.frombuffer(data, np.uint8, escapes, at + 8 * (blocks + 1) + 8 * n_words)
    return unpack(mine, upper[before : before + int(np.count_nonzero(mine >> np.uint64(60) == ESCAPE))])
