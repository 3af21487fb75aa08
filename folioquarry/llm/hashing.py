"""Word and fingerprint hashing in numpy, shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile("[­‐‑-]​?[ \t]*\r?\n[ \t]*(?=[^\\W_])")
_ONE = np.uint64(1)


class Hashes(dict):
    """Word to 64-bit hash; forgets all when it grows over ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = Hashes()


@lru_cache(maxsize=1)
def _unseen() -> re.Pattern:
    """Marks that accents leave when decomposed, and invisible format characters."""
    spans, last = [], None
    for c in [*range(0x80, 0x20000), *range(0xE0000, 0xE01F0)]:
        if unicodedata.category(chr(c)) in ("Mn", "Cf", "Me"):
            if last is not None and spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
            last = c
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]+")


def fold(text: str) -> str:
    """Case, accents, compatibility forms, invisible characters and hyphens at line ends taken away."""
    text = _BREAK.sub("", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text)
    text = _unseen().sub("", _BREAK.sub("", text))
    return unicodedata.normalize("NFKC", text.casefold())


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the folded text."""
    return WORD.findall(fold(text)) if text else []


def hashed(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` consecutive words; none where there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * i + 1)
            out ^= out >> np.uint64(29)
    return mix(out)


def window_simhash(h: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """SimHash of the windows of ``width`` (at most 127) word hashes at every ``step``-th word: a bit is set where most words of the window set it.

    ``width`` is a multiple of ``step``.
    """
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    if step > 1:
        bits = bits[: len(bits) // step * step].reshape(-1, step, 64).sum(1, dtype=np.uint8)
    many = width // step
    n = len(bits) - many + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros((n, 64), dtype=np.uint8)
    done, size, power = 0, 1, bits  # ``power`` holds sums over ``size`` places
    while done < many:
        if many & size:
            total += power[done : done + n]
            done += size
        size *= 2
        if done < many:
            power = power[: len(power) - size // 2] + power[size // 2 :]
    return np.packbits(total * 2 > width, axis=1).view(np.uint64).ravel()


def simhash(features: np.ndarray, weights: np.ndarray | None = None) -> int:
    """SimHash of weighted features; 0 for none."""
    if not len(features):
        return 0
    bits = np.unpackbits(features.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    votes = bits.sum(0) if weights is None else (bits * weights[:, None]).sum(0)
    return int(np.packbits(votes > 0).view(np.uint64)[0])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)
