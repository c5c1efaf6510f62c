"""Periodic runs of words: Lyndon roots extended by constant-time longest common extensions.

Every run of a sequence holds a Lyndon word of its period's length that is the
longest one starting at its place, for one of the two orders of the alphabet.  So
each place gives two candidates, and a candidate is extended to both sides by the
longest common extension of the place and the place one period on: the word depth
of the lowest common ancestor of two leaves, in the suffix tree of the sequence to
the right and in that of its reversal to the left.  Trees are grown by Ukkonen's
method; ancestors come from the least depths on the Euler tour between leaves, by a
sparse table.  The suffix order that gives the Lyndon words is read off the same
tree.

Trees are grown only over stretches that can hold a run.  A run of exponent four
with period q has 3q - 2 places in a row whose three words occur again at most q
further on, so a place is left out when its stretch is too short for its distance.
That test is exact: it loses no run and no part of one.

Defined results: NULL and blank texts have no words and no run; a NULL id is never
rewritten; repeated rows get equal results; an empty table gives no rows; further
columns are not read.  One document is judged by one task; the trees take memory in
proportion to its longest repeating stretch, one tree at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import text_or_empty

LEAST_WORDS, LEAST_EXPONENT = 6, 4
_GRAM = 3


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers from 0 on, with an end mark below all of them."""

    def __init__(self, sequence: np.ndarray):
        self.n = len(sequence)
        self.seq = [int(x) + 1 for x in sequence] + [0]
        self._grow()

    def _grow(self) -> None:
        seq, size = self.seq, len(self.seq)
        start, end, link = [-1], [-1], [0]
        kids: list[dict[int, int] | None] = [{}]
        node, edge, length, remaining = 0, 0, 0, 0
        for i, symbol in enumerate(seq):
            remaining += 1
            pending = -1
            while remaining:
                if not length:
                    edge = i
                child = kids[node].get(seq[edge])
                if child is None:
                    kids[node][seq[edge]] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    kids.append(None)
                    if pending >= 0:
                        link[pending] = node
                    pending = -1
                else:
                    span = min(end[child], i + 1) - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if seq[start[child] + length] == symbol:
                        if pending >= 0:
                            link[pending] = node
                        length += 1
                        break
                    middle = len(start)
                    start.append(start[child])
                    end.append(start[child] + length)
                    link.append(0)
                    start[child] += length
                    kids.append({seq[start[child]]: child, symbol: middle + 1})
                    kids[node][seq[edge]] = middle
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    kids.append(None)
                    if pending >= 0:
                        link[pending] = middle
                    pending = middle
                remaining -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - remaining + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.kids = start, end, kids

    def tour(self, downwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of their leaves, and the least word depth on the Euler tour between neighbours.

        ``downwards`` turns the order of the numbers round; the end mark stays below all.
        """
        start, end, kids, size = self.start, self.end, self.kids, len(self.seq)
        order = np.empty(size, np.int64)
        least = np.zeros(size, np.int64)
        at, lowest = 0, 0
        # Entries: a node and its word depth, or -1 and the depth to which the tour climbs back.
        todo: list[tuple[int, int]] = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            if node < 0:
                lowest = min(lowest, depth)
                continue
            children = kids[node]
            if children is None:
                least[at] = lowest
                order[at] = size - depth
                at += 1
                lowest = depth
                continue
            symbols = sorted(children, reverse=not downwards)
            if downwards and 0 in children:
                symbols = [*(s for s in symbols if s), 0]
            for symbol in symbols:
                child = children[symbol]
                todo.append((-1, depth))
                todo.append((child, depth + end[child] - start[child]))
        return order, least


class Extensions:
    """Longest common extensions of any two places to the right, in constant time."""

    def __init__(self, order: np.ndarray, least: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.levels = [least.astype(np.int32)]
        width = 1
        while 2 * width <= len(least):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from places ``a`` and ``b`` on, which differ."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for one in np.unique(level):
            rows, table = np.flatnonzero(level == one), self.levels[one]
            out[rows] = np.minimum(table[low[rows]], table[high[rows] - (1 << int(one)) + 1])
        return out


def longest_lyndon(rank: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word starting at each place: up to the next smaller suffix."""
    n = len(rank) - 1
    ranks, out, stack = rank.tolist(), [0] * n, [n]
    for i in range(n - 1, -1, -1):
        while ranks[stack[-1]] > ranks[i]:
            stack.pop()
        out[i] = stack[-1] - i
        stack.append(i)
    return np.asarray(out, np.int64)


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n = len(ids)
    dense = np.unique(ids, return_inverse=True)[1]
    forward = SuffixTree(dense)
    order, least = forward.tour()
    turned = forward.tour(downwards=True)[0]
    del forward
    right = Extensions(order, least)
    rank = np.empty(n + 1, np.int64)
    rank[turned] = np.arange(n + 1)
    periods = np.concatenate([longest_lyndon(right.rank), longest_lyndon(rank)])
    places = np.concatenate([np.arange(n), np.arange(n)])
    fits = places + periods < n
    places, periods = places[fits], periods[fits]
    after = right.of(places, places + periods)
    del right
    left = Extensions(*SuffixTree(dense[::-1]).tour())
    # The reversal's suffix at n - i holds the words before place i, backwards.
    before = left.of(n - places, n - places - periods)
    starts, lengths = places - before, before + periods + after
    long = lengths >= np.maximum(least_words, least_exponent * periods)
    return np.unique(np.stack([starts, periods, lengths], 1)[long], axis=0)[:, [0, 2, 1]]


def stretches(ids: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Parts of the sequence that can hold runs; every run lies whole in one part."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    if words < 2_000_000:
        grams = (ids[:-2] * words + ids[1:-1]) * words + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * words + ids[1:], return_inverse=True)[1]
        grams = pairs[:-1] * words + ids[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order[:-1]] == grams[order[1:]]
    if np.count_nonzero(same) < _GRAM:
        return []
    places = order[:-1][same]
    distance = np.zeros(len(grams), np.int64)
    distance[places] = order[1:][same] - places
    places.sort()
    while len(places):
        breaks = np.flatnonzero(np.diff(places) > 1) + 1
        firsts, ends = np.append(0, breaks), np.append(breaks, len(places))
        sizes = ends - firsts
        widest = np.where(sizes >= LEAST_WORDS - _GRAM, (sizes + 2) // 3, 0)
        stays = distance[places] <= np.repeat(widest, sizes)
        if stays.all():
            return [(int(places[a]), min(n, int(places[b - 1]) + int(q) + _GRAM)) for a, b, q in zip(firsts, ends, widest)]
        places = places[stays]
    return []


def whole_runs(ids: np.ndarray, first: int, end: int) -> np.ndarray:
    """Runs of the part [first, end) that the words around it do not extend: others are whole in another part."""
    runs = runs_of(ids[first:end]) + [first, 0, 0]
    start, after, period = runs[:, 0], runs[:, 0] + runs[:, 1], runs[:, 2]
    before = (start > 0) & (ids[start - 1] == ids[np.maximum(start - 1, 0) + period])
    beyond = (after < len(ids)) & (ids[np.minimum(after, len(ids) - 1)] == ids[after - period])
    return runs[~(before | beyond)]


def rewritten(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original word for each place of a document whose id asks for a repeated tail; None where nothing changes."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def judged(doc_id: int | None, text: str, plant: bool = True) -> tuple:
    """One document's figures: runs, the longest one, hashes of all runs and of the words left."""
    words = text.encode().split()
    source = rewritten(doc_id, len(words)) if plant else None
    if source is not None:
        words = [words[i] for i in source.tolist()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = [whole_runs(ids, a, b) for a, b in stretches(ids, len(known))]
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if not len(runs):
        return 0, None, None, None, None, _EMPTY, hashlib.sha256(b" ".join(words)).hexdigest()
    runs = np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in runs.tolist())
    start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()]
    return len(runs), start, length, period, 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


_EMPTY = hashlib.sha256(b"").hexdigest()
_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """Per document its runs, the longest one, and hashes; ``plant`` repeats the tails of one document in ten first."""

    @F.pandas_udf("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [judged(None if doc is None else int(doc), text, plant) for doc, text in zip(ids, texts)]
            frame = pd.DataFrame(rows, columns=_COLUMNS)
            yield frame.astype({c: "Int64" for c in _COLUMNS[:5]})

    # Ids pass as text: a NULL would turn a batch of numbers into floats.
    ids = F.col(id_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), found(ids, text_or_empty(text_col)).alias("f")).select("doc_id", "f.*")
