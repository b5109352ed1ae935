"""Word hashes of many texts at once, in numpy: a text is UTF-8 bytes, a word a run of bytes other than ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_CODE = np.random.default_rng(20240613).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C13
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
#: One odd factor for each place in a window of words.
_PLACE = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 .. n - 1 modulo 2**64, and their inverses."""
    if n <= 4 * CHUNK and "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"][:n]
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(max(n, 1 << max(n - 1, 1 << 16).bit_length()), base, np.uint64)
        x[0] = 1
        np.cumprod(x, out=x)
        out.append(x)
    if n <= 4 * CHUNK:
        _powers["up"], _powers["down"] = out
    return out[0][:n], out[1][:n]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about size bytes together, and the place of the first; a longer text comes alone."""
    begin = total = 0
    for k, text in enumerate(texts):
        if k > begin and total + len(text) > size:
            yield begin, texts[begin:k]
            begin, total = k, 0
        total += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def binary(column: pa.Array) -> list[bytes]:
    """Null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class Words:
    """The words of some texts: starts and ends in buf, first[k] .. first[k + 1] for text k, and 64-bit hashes."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.size = len(texts)
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        length = np.fromiter(map(len, texts), np.int64, self.size) + 1
        self.begin = np.cumsum(length) - length
        gap = _GAP[self.buf]
        edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.first = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))
        up, down = _power(len(self.buf))
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((_CODE[_LOW] if lower else _CODE)[self.buf] * up, out=total[1:])
        own = (total[self.ends] - total[self.starts]) * down[self.starts]
        self.hashes = mix(own + (self.ends - self.starts).astype(np.uint64) * _PLACE[-1])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, those over a text's end included, and which of them lie in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += self.hashes[j : j + n] * _PLACE[j]
        text = np.repeat(np.arange(self.size), np.diff(self.first))
        return mix(out + _U(k)), text[:n] == text[k - 1 :]
