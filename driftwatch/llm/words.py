"""Word, shingle and signature hashes of whole texts, for use inside tasks (numpy only)."""

import numpy as np

SEPARATORS = b" \t\n\x0b\x0c\r"
BLOCK = 1 << 20  # bytes of text hashed at once; a longer text is a block of its own
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])  # separates letters and digits
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SEP = np.zeros(256, bool)
_SEP[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = {}


def mix(x):
    """Scramble 64-bit values, so that each bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base, n):
    """The powers of an odd number. Tasks keep those of a whole block; short texts, as the driver has them, leave nothing
    behind that would travel with every function."""
    if n < BLOCK // 16:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)
    have = _powers.get(base, ())
    if len(have) < n:
        have = np.full(max(n, BLOCK // 2, 2 * len(have)), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def blocks(texts, most=BLOCK):
    """Slices (from, to) of a list of byte strings with at most about `most` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts, separator=_SEP):
    """Hashes of all words of a block of byte strings, A-Z lower-cased, and where each text's words start.

    Returns (hashes, offsets): the words of texts[i] are hashes[offsets[i]:offsets[i + 1]]. A word is a run of bytes
    other than space and \\x09-\\x0d, which is the same for characters, as UTF-8 has these bytes for nothing else;
    or, by `separator`, other than the bytes marked there (the line end must be one).
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(joined)
    sep = separator[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    run = _BYTE[joined]
    run *= _power(_BASE, n)
    run[sep] = 0
    np.cumsum(run, out=run)
    total = run[ends - 1]
    total[1:] -= run[ends[:-1] - 1]
    total *= _power(_BASE_INV, n)[starts]
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return mix(total ^ (ends - starts).astype(np.uint64)), np.searchsorted(starts, begin)


def shingles(words, size):
    """Distinct hashed runs of `size` words, sorted; fewer words are one run; no words give none."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix((words * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = words[: n - size + 1] * _PLACE[0]
    for k in range(1, size):
        out = out + words[k : n - size + 1 + k] * _PLACE[k]
    return np.unique(mix(out))


def shingle_sets(texts, size):
    """Yield the shingle set of each byte string; small blocks, as the sets are held beside them."""
    for a, b in blocks(texts, BLOCK // 4):
        hashes, offsets = word_hashes(texts[a:b])
        for i in range(b - a):
            yield shingles(hashes[offsets[i] : offsets[i + 1]], size)
