"""Word and shingle hashes of whole texts, by numpy over the bytes of many texts at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about this many bytes; longer texts are cut at white space for it.
PIECE = 1 << 20
WIDTH = 5

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PLAIN = np.zeros(256, bool)
PLAIN[65:91] = PLAIN[97:123] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Multipliers, and the default key of the word hash. Whoever knows the key can make words that collide: where texts may
#: be hostile, set another before a job (all tasks of a job need the same).
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
KEY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * PLACES[0]
    x = (x ^ (x >> np.uint64(27))) * PLACES[1]
    return x ^ (x >> np.uint64(31))


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The first 24 bytes of each word as three numbers, zero beyond its end."""
    buffer = np.zeros(len(data) + 32, np.uint8)
    buffer[: len(data)] = data
    window = np.ndarray((len(data) + 24,), "<u8", buffer, strides=(1,))
    out = [window[starts] & KEEP[np.minimum(lengths, 8)]]
    for at in (8, 16):  # few words are so long
        more = np.flatnonzero(lengths > at)
        out.append(np.zeros(len(starts), np.uint64))
        out[-1][more] = window[starts[more] + at] & KEEP[np.minimum(lengths[more] - at, 8)]
    return out


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, lower-cased in A-Z, and for each cut how many words begin before it. No word spans a cut.

    A word's length and its bytes, eight at a time, go through a mixing that is not linear, each time with a part of the
    key; words of more than 24 bytes through blake2b. Different words share a hash with odds of 2**-64.
    """
    inside = ~SPACE[data]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    opens, ends = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[inner] = inside[inner]
    ends[:-1] &= ~inside[1:]
    ends[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(cuts), np.int64)
    lengths = np.flatnonzero(ends) + 1 - starts
    low = FOLD[data]
    parts = packed(low, starts, lengths)
    h = scrambled((parts[0] ^ KEY[0]) + lengths.astype(np.uint64) * PLACES[2])
    for k in (1, 2):
        more = np.flatnonzero(lengths > 8 * k)
        h[more] = scrambled((h[more] ^ parts[k][more]) + KEY[k])
    for i in np.flatnonzero(lengths > 24).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : starts[i] + lengths[i]], digest_size=8, key=KEY.tobytes()).digest(), "little")
    return h, np.searchsorted(starts, cuts)


def breaks(data: np.ndarray, step: int) -> list[int]:
    """Where a long text can be cut at white space into pieces of about `step` bytes; begins with 0 and ends with its length."""
    out = [0]
    while out[-1] < len(data):
        end = min(out[-1] + step, len(data))
        while end < len(data) and not SPACE[data[end]]:  # on to the next white space, in steps
            ahead = np.flatnonzero(SPACE[data[end : end + step]])
            end = end + int(ahead[0]) if len(ahead) else min(end + step, len(data))
        out.append(end)
    return out


def long_words(data: np.ndarray) -> np.ndarray:
    """word_hashes of one text, piece by piece."""
    at = breaks(data, PIECE)
    out = [word_hashes(data[a:b], np.empty(0, np.int64))[0] for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text of an Arrow array, in order; null texts have none."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        if j == i + 1 and offsets[j] - offsets[i] > PIECE:
            yield long_words(data[offsets[i] : offsets[j]])
        else:
            hashes, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield hashes[a:b]
        i = j


def shingles(words: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of all runs of five words; of fewer words, one hash of them all."""
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        return scrambled((words * PLACES[:n]).sum(keepdims=True) + np.uint64(n))
    total = words[: n - 4] * PLACES[0]
    for k in range(1, WIDTH):
        total += words[k : n - 4 + k] * PLACES[k]
    return np.unique(scrambled(total))


def class_of(s: np.ndarray) -> int:
    """A number that equal sets share."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
