"""Words and their hashes for the operators that work on batches of texts.

Words are hashed from the bytes of an Arrow column at once: each byte has a random number, a word is the sum of these
times powers of an odd number by place, modulo 2 ** 64, read as a difference of running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that are worked on at once: texts may be long and a worker's memory is small.
ROWS_IN_BATCH, BYTES_IN_BATCH = 1_024, 1_000_000
CACHED_WORDS = 300_000
U64 = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=U64)
BASE = 0x5851F42D4C957F2D
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_values() -> np.ndarray:
    """A number for each byte, the same for A-Z as for a-z."""
    out = mix64(np.arange(1, 257, dtype=U64) * ODD[0])
    out[ord("A") : ord("Z") + 1] = out[ord("a") : ord("z") + 1]
    return out


VALUES = _byte_values()
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """BASE ** k and its inverse for k below n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + n // 4, U64(base))
            steps[0] = U64(1)
            _powers[k] = np.cumprod(steps)
    return _powers


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    r"""(hashes, at): the 64-bit hashes of all words [^\x20\x09-\x0D]+ with A-Z in lower case; text t has at[t] to at[t + 1]."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    edges = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(edges[-1] - edges[0])
    if not size:
        return np.empty(0, U64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    space = SPACES[data]
    begin = np.ones(size + 1, bool)  # what stands before a byte ends a word: a space or the end of a text
    begin[1:-1] = space[:-1]
    begin[edges] = True
    starts = np.flatnonzero(~space & begin[:-1])
    stops_here = begin[1:].copy()
    stops_here[:-1] |= space[1:]
    stops = np.flatnonzero(~space & stops_here) + 1
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):  # as many words at once as have about BYTES_IN_BATCH bytes
        hi = max(lo + 1, int(np.searchsorted(stops, starts[lo] + BYTES_IN_BATCH)))
        a, b = int(starts[lo]), int(stops[hi - 1])
        powers, inverses = _power_tables(b - a)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(VALUES[data[a:b]] * powers[: b - a], out=sums[1:])
        first, last = starts[lo:hi] - a, stops[lo:hi] - a
        out[lo:hi] = (sums[last] - sums[first]) * inverses[first] + (last - first).astype(U64)
        lo = hi
    return mix64(out), np.searchsorted(starts, edges)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences in order; none if there are fewer words."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = h[:m] * ODD[0]
    for i in range(1, n):
        out += h[i : i + m] * ODD[i % len(ODD)] + U64(i)
    return mix64(out)


def text_grams(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Hashes of the n-word sequences of each text in order."""
    h, at = word_hashes(texts)
    every = grams(h, n)
    return [every[a : max(a, b - n + 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each text; with fewer words, the whole sequence as one; none without words."""
    h, at = word_hashes(texts)
    every = grams(h, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(every[a : b - n + 1]) if b - a >= n else grams(h[a:b], b - a) + U64(b - a) if b > a else np.empty(0, U64))
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of at most ROWS_IN_BATCH rows and about BYTES_IN_BATCH bytes (one row at least)."""
    for batch in batches:
        rows = max(1, min(ROWS_IN_BATCH, BYTES_IN_BATCH * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def small_batches(spark) -> Iterator[None]:
    """Batches that Spark sends to Python are small for what is run within, whatever the session has before and after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS_IN_BATCH), "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * BYTES_IN_BATCH)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def list_column(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    """A list column from all values in order and the size of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def unused(name: str, columns: list[str]) -> str:
    """name, with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
