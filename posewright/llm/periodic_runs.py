"""Runs of periodic words on a harmonic grid.

A run of period p has at least LEAST_EXPONENT * p words, so it covers that many neighbouring points 0, p, 2p, ... of
the grid of p, all with one and the same word; over all periods of a text of n words the grids have some n log n points.
For each point jp whose next points agree, the longest common extension of jp and (j + 1)p is asked for forward and
backward; both together are the run's bounds. Forward ones are range minima of the common prefixes between the two
places in a suffix array; backward ones are the same over the reversed words. A run turns up once for each multiple of
its smallest period; the smallest is kept.

Texts are numbered words; those of a group of texts that have points to be asked for share one suffix array, parted by
symbols that occur once each, so no extension leaves its text. A document is one row of one task, and nothing is shuffled.

Edge cases: null and empty texts and texts of spaces have no word and no run; repeated rows are judged alike; a null id
hashes as the empty string; of runs with equal exponents the first, then the one of the smaller period, is the greatest;
an empty table gives an empty result; memory grows with the longest text alone, whose grids are walked some points at a
time; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posewright.llm.common import read
from posewright.llm.hashing import GROUP_BYTES
from posewright.llm.suffix_array import permuted_common_prefixes, suffix_array

LEAST_EXPONENT = 4
LEAST_LENGTH = 6
#: Texts of up to so many words read their grid off a kept one; longer ones walk POINTS points at a time.
KEPT_WORDS = 1 << 14
POINTS = 1_000_000
BLOCK = 16
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def points(low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, period): the grid points of the periods from low to high - 1 that have LEAST_EXPONENT - 1 more behind them."""
    periods = np.arange(low, high)
    counts = np.maximum(0, (n - 1) // periods + 2 - LEAST_EXPONENT)
    period = np.repeat(periods, counts)
    return (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period, period


@lru_cache(2)
def kept_points(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points of a text of n words in the order of the last word they need, and that word's number."""
    at, period = points(1, n // LEAST_EXPONENT + 1, n)
    last = at + (LEAST_EXPONENT - 1) * period
    order = np.argsort(last, kind="stable")
    return at[order], period[order], last[order]


def grids(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if n <= KEPT_WORDS:
        at, period, last = kept_points(max(256, 1 << (n - 1).bit_length()))
        end = np.searchsorted(last, n)
        yield at[:end], period[:end]
        return
    low = 1
    while low <= n // LEAST_EXPONENT:
        high = low + max(1, POINTS * low // n)
        yield points(low, min(high, n // LEAST_EXPONENT + 1), n)
        low = high


def agreeing_points(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(at, period): the points whose word is that of their next LEAST_EXPONENT - 1 points, a grid or a part of one at a time."""
    for at, period in grids(len(words)):
        for k in range(1, LEAST_EXPONENT):
            same = words[at] == words[at + k * period]
            at, period = at[same], period[same]
        if len(at):
            yield at, period


class RangeMinima:
    """Least value of any range: minima from block ends within blocks, doubled ranges over whole blocks."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.values = np.append(values, np.full(-self.n % BLOCK, np.iinfo(np.int32).max)).astype(np.int32)
        rows = self.values.reshape(-1, BLOCK)
        self.upto, self.onward = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [rows.min(1)]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[: len(low) - step], low[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of values[low..high], both inclusive."""
        a, z = low // BLOCK, high // BLOCK
        out = np.minimum(self.onward[low], self.upto[high])
        for level in range(len(self.levels)):
            inner = z - a - 1
            asked = np.flatnonzero((inner >= 1 << level) & (inner < 2 << level))
            if len(asked):
                table = self.levels[level]
                out[asked] = np.minimum(out[asked], np.minimum(table[a[asked] + 1], table[z[asked] - (1 << level)]))
        inside = np.flatnonzero(a == z)
        if len(inside):
            first = low[inside]
            best = self.values[first].copy()
            for k in range(1, BLOCK):
                more = first + k <= high[inside]
                best[more] = np.minimum(best[more], self.values[first[more] + k])
            out[inside] = best
        return out


class Extensions:
    """Longest common extensions of any two places of a string of numbers."""

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_array(symbols)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.minima = RangeMinima(permuted_common_prefixes(symbols, order)[order])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.place[a], self.place[b]
        return self.minima.least(np.minimum(x, y) + 1, np.maximum(x, y))


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


class Text:
    """A string of numbers with its extensions forward and backward, which are built when they are first asked for."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, self.ways = symbols, None

    def runs(self, at: np.ndarray, period: np.ndarray) -> Runs:
        """(start, end, period) of the long enough runs through the points, each once."""
        n = len(self.symbols)
        if self.ways is None:
            self.ways = Extensions(self.symbols), Extensions(np.ascontiguousarray(self.symbols[::-1]))
        forward = self.ways[0].common(at, at + period)
        start = at - self.ways[1].common(n - 1 - at, n - 1 - at - period) + 1
        end = at + period + forward
        long = end - start >= np.maximum(LEAST_LENGTH, LEAST_EXPONENT * period)
        return distinct(start[long], end[long], period[long])


def distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Runs:
    """Each pair of bounds once with its smallest period, in the order of start and period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def joined_runs(parts: list[Runs]) -> Runs:
    return distinct(*(np.concatenate([*(p[k] for p in parts), np.zeros(0, np.int64)]) for k in range(3)))


def periodic_runs(words: list[np.ndarray]) -> list[Runs]:
    """(start, end, period) of the runs of each text of numbered words, in the order of start and period."""
    out, asked = [joined_runs([])] * len(words), []
    for k, own in enumerate(words):
        if len(own) > KEPT_WORDS:  # on its own, its points some at a time
            text = Text(np.unique(own, return_inverse=True)[1])
            out[k] = joined_runs([text.runs(at, period) for at, period in agreeing_points(own)])
        else:
            asked += [(k, at, period) for at, period in agreeing_points(own)]
    if not asked:
        return out
    # behind each text a symbol of its own, larger than all words
    parts, offset, begins = [], 0, []
    top = max(int(words[k].max()) for k, _, _ in asked) + 1
    for j, (k, _, _) in enumerate(asked):
        parts += [words[k], [top + j]]
        begins.append(offset)
        offset += len(words[k]) + 1
    text = Text(np.unique(np.concatenate(parts), return_inverse=True)[1])
    start, end, period = text.runs(np.concatenate([at + b for (_, at, _), b in zip(asked, begins)]), np.concatenate([p for _, _, p in asked]))
    cuts = np.searchsorted(start, [*begins, offset])
    for (k, _, _), b, a, z in zip(asked, begins, cuts, cuts[1:]):
        out[k] = (start[a:z] - b, end[a:z] - b, period[a:z])
    return out


def dealt(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place, by the hash of the id; None: all stay."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapse_mask(n: int, runs: Runs) -> np.ndarray:
    """False for each word that a run holds after its first period."""
    start, end, period = runs
    cover = np.bincount(start + period, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(cover)[:n] == 0


def summary(runs: Runs) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256) of the runs of one text."""
    rows = [(s, e - s, p) for s, e, p in zip(*(x.tolist() for x in runs))]
    digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in rows).encode()).hexdigest()
    if not rows:
        return 0, None, None, None, None, digest
    s, n, p = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
    return len(rows), s, n, p, 1000 * n // p, digest


def text_slices(column: pa.Array) -> Iterator[pa.Array]:
    """Some GROUP_BYTES of texts at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and size + n > GROUP_BYTES:
            yield column.slice(begin, k - begin)
            begin, size = k, 0
        size += n
    if len(column):
        yield column.slice(begin)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_runs, the greatest run and the digests of all runs and of the collapsed text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(begin, len(texts))
                begin += len(texts)
                split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
                owner, words = pc.list_parent_indices(split), pc.list_flatten(split)
                full = pc.not_equal(words, "")
                owner, words = owner.filter(full).to_numpy(), words.filter(full)
                counts = np.bincount(owner, minlength=len(texts))
                bounds = np.concatenate(([0], np.cumsum(counts)))
                at = np.arange(len(words))
                for k, name in enumerate(ids.to_pylist()):
                    moved = dealt(int(counts[k]), crc32(("" if name is None else str(name)).encode()))
                    if moved is not None:
                        at[bounds[k] : bounds[k + 1]] = bounds[k] + moved
                numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)[at]
                runs = periodic_runs([numbers[a:z] for a, z in zip(bounds, bounds[1:])])
                keep = np.ones(len(words), bool)
                for k, found in enumerate(runs):
                    if len(found[0]):
                        keep[bounds[k] : bounds[k + 1]] = collapse_mask(int(counts[k]), found)
                left = np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(at[keep])).cast(pa.string())), " ")
                columns = zip(*map(summary, runs))
                kinds = [pa.int64()] * 5 + [pa.string()]
                collapsed = pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in joined], pa.string())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds)), collapsed], names=[id_col, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return find_runs(read(spark, sf_dir, "documents"))
