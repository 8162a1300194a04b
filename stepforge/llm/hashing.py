"""Vectorised word hashing: a whole batch of texts is hashed with array operations, not word by word."""

import numpy as np

SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K = np.uint64(0xD6E8FEB86659FD93)
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part words of letters and digits: all of ASCII but those.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int):
    have = _powers.get("n", 0)
    if have < n:
        n = max(n, SEGMENT + 1)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("q", _BASE_INV)):
                a = np.full(n, base, np.uint64)
                a[0] = 1
                _powers[name] = np.multiply.accumulate(a)
        _powers["n"] = n
    return _powers["p"], _powers["q"]


def _hash_segment(arr: np.ndarray, ws: np.ndarray, prefixes: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Start position and hash of each word of a piece that begins and ends between words; then, for each k of prefixes,
    of the first k bytes of each longer word."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], ws, [True]))))
    s, e = edge[0::2], edge[1::2]
    p, q = _power_table(len(arr) + 1)
    total = np.empty(len(arr) + 1, np.uint64)
    total[0] = 0
    np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * p[: len(arr)], out=total[1:])
    starts, hashes = [s], [mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64) * _K)]
    for k in prefixes:
        t = s[e - s > k]
        starts.append(t)
        hashes.append(mix((total[t + k] - total[t]) * q[t] + np.array([k], np.uint64) * _M1))
    if not prefixes:
        return s, hashes[0]
    s = np.concatenate(starts)
    order = np.argsort(s, kind="stable")
    return s[order], np.concatenate(hashes)[order]


def word_hashes(texts, lower: bool = True, breaks: np.ndarray = _WS, prefixes: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text as 64-bit hashes: (hashes, bounds), text i has hashes[bounds[i]:bounds[i+1]].
    breaks: which bytes part words (the space always does). prefixes: adds a hash of that many leading bytes of longer words."""
    parts = [(t.encode("utf-8", "surrogatepass") if t else b"") for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in parts), np.int64, len(parts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + SEGMENT)
        if end < len(raw):
            gaps = np.flatnonzero(breaks[raw[at:end]])
            while not len(gaps) and end < len(raw):  # one word longer than a segment
                end = min(len(raw), end + SEGMENT)
                gaps = np.flatnonzero(breaks[raw[at:end]])
            end = at + int(gaps[-1]) + 1
        piece = raw[at:end]
        ws = breaks[piece]
        s, h = _hash_segment(_LOWER[piece] if lower else piece, ws, prefixes)
        starts.append(s + at)
        hashes.append(h)
        at = end
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return h, np.searchsorted(s, first)


def shingle_sets(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each lower-cased text: (hashes, bounds). Fewer than n words: the whole
    sequence is one shingle; no word: none."""
    h, b = word_hashes(texts)
    start, end = b[:-1], b[1:]
    if n == 1:
        sh = h.copy()
        valid = np.ones(len(h), bool)
    else:
        sh = h.copy()
        for j in range(1, n):
            sh[: len(h) - j] = mix(sh[: len(h) - j] * _K + h[j:])
        valid = np.ones(len(h), bool)
        for j in range(1, n):
            last = end - j
            valid[last[last >= start]] = False
    count = np.maximum(end - start - n + 1, 0)
    short = np.flatnonzero((end > start) & (end - start < n))
    for i in short:  # at most n - 1 words each
        x = np.uint64(end[i] - start[i])
        for w in h[start[i] : end[i]]:
            x = mix(np.array([x]) * _K + w)[0]
        sh[start[i]] = x
        valid[start[i]] = True
        count[i] = 1
    out = sh[valid]
    bounds = np.concatenate(([0], np.cumsum(count)))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[s:e].sort()
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[bounds[:-1][count > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[bounds]


def batches_by_bytes(texts, most: int = 1 << 19):
    """Index ranges of consecutive texts of about `most` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
