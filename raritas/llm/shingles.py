"""Words and word shingles as 64-bit hashes, computed on the bytes of whole Arrow batches."""

from __future__ import annotations

import numpy as np

from raritas.llm.common import SPACES

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
PIECE_BYTES = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < size:
        for place, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[place] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:size], _powers[1][:size]


def _hash_piece(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ascending spans ``data[begin:end]``. Long data are hashed in pieces that end between spans."""
    out = np.empty(len(begin), dtype=np.uint64)
    first = 0
    while first < len(begin):
        stop = max(first + 1, int(np.searchsorted(end, begin[first] + PIECE_BYTES, side="right")))
        a, z = begin[first], end[stop - 1]
        out[first:stop] = _hash_piece(data[a:z], begin[first:stop] - a, end[first:stop] - a)
        first = stop
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than ASCII white space, A-Z in lower case) of all rows, and the bounds of
    each row among them."""
    upper = (data >= 0x41) & (data <= 0x5A)
    data = data + (upper.view(np.uint8) << 5)
    blank = SPACES[data]
    starts, ends = ~blank, ~blank
    if len(data) > 1:
        starts[1:] &= blank[:-1]
        ends[:-1] &= blank[1:]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    starts[heads] |= ~blank[heads]
    tails = bounds[1:][bounds[1:] > 0] - 1
    ends[tails] |= ~blank[tails]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return hash_spans(data, begin, end), np.searchsorted(begin, bounds)


def run_hashes(tokens: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbouring tokens."""
    n = max(0, len(tokens) - length + 1)
    hashed = np.full(n, length, dtype=np.uint64)
    for k in range(length):
        hashed = mixed(hashed * _BASE + tokens[k : k + n])
    return hashed


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending within the row, and the bounds of each row among them.

    A row with fewer words than ``words`` has its whole sequence as one shingle; without words its set is empty.
    """
    tokens, rows = word_hashes(data, bounds)
    count = np.diff(rows)
    owner = np.repeat(np.arange(len(count)), count)
    hashed = run_hashes(tokens, words)
    inside = owner[: len(hashed)] == owner[words - 1 :] if len(hashed) else np.zeros(0, dtype=bool)
    found, owners = [hashed[inside]], [owner[: len(hashed)][inside]]
    for length in range(1, words):
        short = np.flatnonzero(count == length)
        if len(short):
            whole = np.full(len(short), length, dtype=np.uint64)
            for k in range(length):
                whole = mixed(whole * _BASE + tokens[rows[short] + k])
            found.append(whole)
            owners.append(short)
    hashed, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    fresh = np.ones(len(hashed), dtype=bool)
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    hashed, owner = hashed[fresh], owner[fresh]
    return hashed, np.searchsorted(owner, np.arange(len(count) + 1))
