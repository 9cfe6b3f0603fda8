"""Words of many texts at once as hashes: arrays over a batch instead of a loop over words.

A word is a run of characters other than ASCII white space, in lower case. Its hash is a polynomial
in its bytes, taken from one running sum over the batch; equal words have equal hashes, and different
ones collide about as rarely as random 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from .common import worker_state

# Texts are hashed in runs of about this many characters, which bounds the memory of a task.
RUN_CHARS = 1 << 20


def _tables():
    import numpy as np

    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x):
    """A good hash of 64-bit numbers (the finish of splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(texts: list[str]):
    """Hashes of all words of ``texts``, one after another, and where each text's words begin (one more at the end)."""
    import numpy as np

    byte_value, base, inverse = worker_state("word tables", _tables)
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    ends_of_texts = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) and len(ends) > len(starts):
        ends = ends[len(ends) - len(starts):]
    n = len(raw)
    power = np.full(n + 1, base, np.uint64)
    power[:1] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_value[raw] * power[:-1], out=total[1:], dtype=np.uint64)
    back = np.full(n + 1, inverse, np.uint64)
    back[:1] = 1
    back = np.cumprod(back, dtype=np.uint64)
    hashes = mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.concatenate([[0], np.searchsorted(starts, ends_of_texts)]).astype(np.int64)


def in_runs(rows: Iterable[tuple], chars: int = RUN_CHARS) -> Iterator[list[tuple]]:
    """Rows with a text last, in lists of about ``chars`` characters; null texts become empty."""
    held, size = [], 0
    for *keys, text in rows:
        held.append((*keys, text or ""))
        size += len(text or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(hashes, n: int):
    """Hashes of the runs of ``n`` words that begin at each word; the last ``n - 1`` words begin none."""
    import numpy as np

    count = max(len(hashes) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + count]
    return mixed(out)


def shingle_set(hashes, n: int = 5):
    """The distinct runs of ``n`` words, sorted; a shorter text that has words is one run by itself."""
    import numpy as np

    if 0 < len(hashes) < n:
        return grams(hashes, len(hashes))
    return np.unique(grams(hashes, n))
