"""Vectorised word and line hashing over UTF-8 bytes, shared by the text operators.

A block of texts is laid out as one byte buffer.  Word borders come from a byte
class table, and a word's 64-bit hash is a difference of running polynomial
sums, so no Python code runs per word.  Blocks have about BLOCK bytes; a longer
text is cut at word borders, so memory stays in proportion to BLOCK plus eight
bytes per word, whatever the length of one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def byte_class(separators: Iterable[int]) -> np.ndarray:
    """1 for bytes of words, 0 for separators."""
    table = np.ones(256, np.int8)
    table[list(separators)] = 0
    return table


#: Words are runs without space, tab, line feed, vertical tab, form feed, return.
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, lower-case letters and non-ASCII characters.
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _pieces(texts: list[bytes], table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Texts, the long ones cut behind a separator."""
    for k, text in enumerate(texts):
        at = 0
        while len(text) - at > BLOCK:
            cut = at + BLOCK
            while True:
                gaps = np.flatnonzero(table[np.frombuffer(text, np.uint8, cut - at, at)] == 0)
                if len(gaps) or cut == len(text):
                    break
                cut = min(len(text), cut + BLOCK)
            cut = at + int(gaps[-1]) + 1 if len(gaps) else len(text)
            yield k, text[at:cut]
            at = cut
        yield k, text[at:] if at else text


def _hashed(pieces: list[bytes], table: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, and of their first bytes for each length of prefixes; first byte and end of each word; bytes."""
    buffer = b"\n".join(pieces)
    raw = np.frombuffer(buffer, np.uint8)
    edges = np.zeros(len(raw) + 2, np.int8)
    edges[1:-1] = table[raw]
    edges = np.diff(edges)
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    out = [mix((total[end] - total[first]) * inverse[first])]
    for n in prefixes:
        out.append(mix((total[np.minimum(end, first + n)] - total[first]) * inverse[first] + np.uint64(n)))
    return out, first, end, raw


def word_blocks(texts: list[str | None], table: np.ndarray, lower: bool = True, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Blocks of (word hashes and prefix hashes, number of their text), in order; null is empty."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        coded = [t.translate(LOWER) for t in coded]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> tuple[list[np.ndarray], np.ndarray]:
        hashes, first, _, _ = _hashed([b for _, b in held], table, prefixes)
        starts = np.cumsum([0, *(len(b) + 1 for _, b in held[:-1])])
        owner = np.array([k for k, _ in held])[np.searchsorted(starts, first, "right") - 1]
        return hashes, owner

    for k, piece in _pieces(coded, table):
        if held and size + len(piece) > BLOCK:
            yield flush()
            held, size = [], 0
        held.append((k, piece))
        size += len(piece) + 1
    if held:
        yield flush()


def words_of(texts: list[str | None], table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, border of each text's words: one more than texts)."""
    blocks = list(word_blocks(texts, table, lower))
    hashes = np.concatenate([h[0] for h, _ in blocks]) if blocks else np.zeros(0, np.uint64)
    owner = np.concatenate([o for _, o in blocks]) if blocks else np.zeros(0, np.int64)
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def count_words(texts: list[str | None], table: np.ndarray = SPACED) -> list[int]:
    """Words of each text."""
    out = []
    for text in texts:
        total, last = 0, 0
        coded = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(coded), BLOCK):
            word = table[np.frombuffer(coded, np.uint8, min(BLOCK, len(coded) - at), at)]
            total += int(np.count_nonzero(np.diff(word, prepend=np.int8(last)) == 1))
            last = int(word[-1])
        out.append(total)
    return out


def line_blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (word hash, word has a digit, its line, its text) for texts cut at line feeds.

    Lines count from 0 in each text; a text longer than a block is cut behind a line feed.
    """
    feeds = byte_class([0x0A])
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        (hashes,), first, end, raw = _hashed([b for _, _, b in held], SPACED)
        digits = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((raw >= 48) & (raw <= 57), out=digits[1:])
        line = np.cumsum(raw == 10)
        starts = np.cumsum([0, *(len(b) + 1 for _, _, b in held[:-1])])
        piece = np.searchsorted(starts, first, "right") - 1
        before = np.append(0, line)[starts]
        offset = np.array([n for _, n, _ in held])
        return hashes, digits[end] > digits[first], line[first] - before[piece] + offset[piece], np.array([k for k, _, _ in held])[piece]

    lines, last = 0, -1
    for k, part in _pieces([(t or "").encode("utf-8", "surrogatepass").translate(LOWER) for t in texts], feeds):
        lines = lines if k == last else 0
        if held and size + len(part) > BLOCK:
            yield flush()
            held, size = [], 0
        held.append((k, lines, part))
        size += len(part) + 1
        lines, last = lines + part.count(b"\n"), k
    if held:
        yield flush()


def run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from first to end, in their order, for many runs at once."""
    power, inverse = _power(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first])


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out + np.uint64(n))


def shingle_sets(texts: list[str | None], n: int, table: np.ndarray = SPACED) -> list[np.ndarray]:
    """Each text's distinct n-word shingles, sorted; fewer words make one shingle, no words none."""
    hashes, border = words_of(texts, table)
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
        own = hashes[a:b]
        out.append(np.unique(combine(own, min(n, len(own)))) if len(own) else np.zeros(0, np.uint64))
    return out
