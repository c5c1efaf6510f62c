"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of word shingles.  Documents with one and the same set form
a class and are compared once.  MinHash values are cut into bands; two classes
that agree in a band are candidates.  Candidates are compared some MinHash values
at a time: with m of n values equal and a flat prior, the similarity has a Beta
posterior, and a pair is dropped once the probability that it reaches the
threshold falls below the tolerance.  What is left is verified exactly on the
shingles of the whole texts.

Large buckets are dealt into chunks by a hash, and each pair of chunks is a unit
of its own, so no task holds a bucket whole.  A pair is compared only in the
first band in which it agrees.  Pairs stay arrays inside units and leave them as
sums and trees, never as rows.

Chance of losing a pair at the threshold: 5e-8 by banding (32 bands of 4 at 0.8)
and about the tolerance by pruning.

Defined results: a text without words has no shingles, links to nothing and is a
class of its own; a text of fewer words than a shingle is one shingle; repeated
rows count as documents with the same set; the class of rows whose ids are all
NULL is NULL; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import lean, settle, text_or_empty, whole_groups
from traitlens.llm.components import components
from traitlens.llm.word_hash import text_hashes, windows
from traitlens.sources.store import join_small

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
ROWS = 4
STEP = 16
TOLERANCE = 1e-6
#: A unit of pairs holds about this many documents of up to ``_UNIT_SHINGLES`` shingles a side, fewer longer ones.
_UNIT = 512
_UNIT_SHINGLES = 600
_PAIRS = 40_000
_KEPT_TRIANGLE = 64

_rng = np.random.Generator(np.random.PCG64(77))
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)


def shingle_set(words: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word windows."""
    if 0 < len(words) < shingle:
        return windows(words, len(words)) + np.uint64(len(words))
    return np.unique(windows(words, shingle))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The upper 16 bits of the smallest value of each hash function over the set."""
    smallest = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        values = shingles[at : at + 2048, None] * _FACTORS + _SHIFTS
        np.minimum(smallest, values.min(axis=0), out=smallest)
    # The smallest of many values has empty upper bits; its lower ones still tell minima apart.
    return ((smallest * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, set key (NULL without words), number of shingles and signature of every row."""

    @F.pandas_udf("key binary, shingles int, signature binary")
    @lean
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, counts, signatures = [], [], []
            for words in text_hashes(batch):
                found = shingle_set(words)
                counts.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "shingles": counts, "signature": pd.Series(signatures, dtype=object)})

    made = sketch.asNondeterministic()(F.col("text"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.withColumn("s", made).select("doc_id", "text", "s.*")


def posterior(matches: int, seen: int, threshold: float) -> float:
    """P(similarity >= threshold) given ``matches`` of ``seen`` equal values and a flat prior: a Beta tail as a binomial sum."""
    n = seen + 1
    return sum(math.comb(n, j) * threshold**j * (1 - threshold) ** (n - j) for j in range(matches + 1))


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After each step, the fewest equal values with which a pair stays."""
    return tuple(next(m for m in range(n + 1) if posterior(m, n, threshold) >= tolerance) for n in range(STEP, HASHES + 1, STEP))


def surviving(values: np.ndarray, sizes: np.ndarray, band: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows agree first in this band and survive the incremental comparison."""
    small, large = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
    alive = np.flatnonzero(small >= threshold * large - 1e-9)
    bands = values.view("<u8")
    agree = bands[left[alive]] == bands[right[alive]]
    alive = alive[agree.argmax(axis=1) == band[left[alive]]]
    matches = np.zeros(len(alive), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (values[left[alive], part] == values[right[alive], part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


@lru_cache(maxsize=_KEPT_TRIANGLE)
def _kept_triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of n rows; only those of small units are kept, as large ones take megabytes each."""
    return _kept_triangle(n) if n <= _KEPT_TRIANGLE else np.triu_indices(n, 1)


def candidate_units(classes: DataFrame) -> DataFrame:
    """Rows (unit, band, cross, second, cid, shingles, signature): who is compared with whom in each unit."""
    width = 2 * ROWS
    hashes = [F.xxhash64(F.lit(b), F.substring("signature", b * width + 1, width)) for b in range(HASHES // ROWS)]
    weight = 1 + F.col("shingles") / _UNIT_SHINGLES
    in_band = classes.select("cid", weight.alias("weight"), F.posexplode(F.array(*hashes)).alias("band", "bucket"))
    shared = in_band.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).where("n > 1")
    chunks = F.ceil(F.col("weight") / _UNIT).cast("int")
    members = in_band.drop("weight").join(shared.select("bucket", chunks.alias("chunks")), "bucket")
    # A member of a chunked bucket meets its own chunk and every other one; a pair of chunks is one unit.
    own = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.concat_ws("/", "bucket", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    rows = dealt.select(unit.alias("unit"), "band", (F.col("own") != F.col("other")).alias("cross"), (F.col("own") > F.col("other")).alias("second"), "cid")
    return rows.join(classes.select("cid", "shingles", "signature"), "cid")


def compare_units(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(unit, left_ids, right_ids) of the surviving pairs of each unit that has any."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "unit"):
            values = np.frombuffer(b"".join(frame["signature"]), "<u2").reshape(len(frame), HASHES)
            sizes, band, ids = frame["shingles"].to_numpy(), frame["band"].to_numpy(), frame["cid"].to_numpy()
            second, cross, unit = frame["second"].to_numpy(), frame["cross"].to_numpy(), frame["unit"].to_numpy()
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            ends = np.append(starts[1:], len(unit))
            kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def decide() -> None:
                left, right = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
                for at in range(0, len(left), _PAIRS):
                    a, b = left[at : at + _PAIRS], right[at : at + _PAIRS]
                    alive = surviving(values, sizes, band, a, b, threshold)  # noqa: B023
                    a, b = a[alive], b[alive]
                    new = np.flatnonzero(np.append(True, unit[a][1:] != unit[a][:-1])) if len(a) else []  # noqa: B023
                    for pa, pb in zip(np.split(a, new[1:]), np.split(b, new[1:])) if len(a) else ():
                        kept.setdefault(unit[pa[0]], []).append((ids[pa], ids[pb]))  # noqa: B023
                waiting.clear()

            for begin, end in zip(starts, ends):
                if cross[begin]:
                    rows = np.arange(begin, end)
                    first, other = rows[~second[begin:end]], rows[second[begin:end]]
                    pair = np.repeat(first, len(other)), np.tile(other, len(first))
                else:
                    i, j = _triangle(end - begin)
                    pair = i + begin, j + begin
                if len(pair[0]):
                    waiting.append(pair)
                    size += len(pair[0])
                if size >= _PAIRS:
                    decide()
                    size = 0
            if waiting:
                decide()
            yield pd.DataFrame(
                [(u, np.concatenate([p[0] for p in ps]), np.concatenate([p[1] for p in ps])) for u, ps in kept.items()],
                columns=["unit", "left_ids", "right_ids"],
            )

    return units.repartition("unit").sortWithinPartitions("unit").mapInPandas(lean(compare), "unit string, left_ids array<long>, right_ids array<long>")


def verify_units(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, root, links) per unit: exact links of a class, copies counted, and one node of its linked group.

    ``texts`` has (cid, copies, text).  Of each unit's documents all shingles are numbered; a document
    is marked once and counted against all of its partners.
    """
    wanted = pairs.select("unit", F.explode(F.array_distinct(F.concat("left_ids", "right_ids"))).alias("cid")).join(texts, "cid")
    none = F.lit(None)
    rows = pairs.select("unit", "left_ids", "right_ids", none.cast("long").alias("cid"), none.cast("long").alias("copies"), none.cast("string").alias("text")).unionByName(
        wanted.select("unit", none.cast("array<long>").alias("left_ids"), none.cast("array<long>").alias("right_ids"), "cid", "copies", "text")
    )

    def one(group: pd.DataFrame) -> list[tuple[int, int, int]]:
        head, docs = group[group["cid"].isna()].iloc[0], group[group["cid"].notna()]
        ids, copies = docs["cid"].to_numpy(np.int64), docs["copies"].to_numpy(np.int64)
        sets = [shingle_set(w) for w in text_hashes(docs["text"])]
        sizes = np.asarray([len(s) for s in sets])
        numbered = np.unique(np.concatenate(sets), return_inverse=True)[1]
        borders = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(ids)
        at = lambda wanted: order[np.searchsorted(ids, wanted, sorter=order)]
        left, right = at(np.asarray(head["left_ids"], np.int64)), at(np.asarray(head["right_ids"], np.int64))
        by_left = np.argsort(left, kind="stable")
        left, right = left[by_left], right[by_left]
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        linked = np.zeros(len(ids), bool)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        marked = np.zeros(int(numbered.max()) + 1, bool)
        for part in np.split(np.arange(len(left)), np.flatnonzero(np.diff(left)) + 1):
            a, partners = left[part[0]], right[part]
            own = numbered[borders[a] : borders[a + 1]]
            marked[own] = True
            common = np.asarray([np.count_nonzero(marked[numbered[borders[b] : borders[b + 1]]]) for b in partners])
            marked[own] = False
            similar = partners[common >= threshold * (sizes[a] + sizes[partners] - common) - 1e-9]
            links[a] += copies[similar].sum()
            links[similar] += copies[a]
            linked[similar] = True
            linked[a] |= len(similar) > 0
            for b in similar:
                root[top(b)] = top(a)
        return [(int(ids[x]), int(ids[top(x)]), int(links[x])) for x in np.flatnonzero(linked)]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "unit"):
            found = [row for _, group in frame.groupby("unit", sort=False) for row in one(group)]
            yield pd.DataFrame(found, columns=["cid", "root", "links"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInPandas(lean(verify), "cid long, root long, links long")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, unique_ids: bool = False) -> DataFrame:
    """doc_id, class_id (smallest id among all documents linked to it, directly or over others) and n_links of every row.

    ``unique_ids`` says that ``docs`` is a settled table whose ids name its rows: its texts are then read again, not copied.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    # Rows have numbers of their own from here on: ids may repeat or be missing.
    if unique_ids:
        sketched = settle(sketches(docs, id_col, text_col).drop("text").withColumn("row", F.col("doc_id")))
        source = docs.select(F.col(id_col).alias("row"), text_or_empty(text_col).alias("text"))
    else:
        sketched = settle(sketches(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
        source = sketched.select("row", "text")
    grouped = sketched.where("key is not null").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"), F.first("signature").alias("signature")
    )
    # Numbers are fixed once the table is written.
    classes = settle(grouped.withColumn("cid", F.monotonically_increasing_id()))
    pairs = settle(compare_units(candidate_units(classes), threshold))
    needed = settle(pairs.select(F.explode(F.array_distinct(F.concat("left_ids", "right_ids"))).alias("cid")).distinct().join(classes.select("cid", "row", "copies"), "cid"))
    # One text for each needed class; the list is broadcast while it is short, else the texts are shuffled.
    texts = settle(join_small(source, needed, ["row"]).select("cid", "copies", "text"))
    verified = settle(verify_units(pairs, texts, threshold))
    parts = components(verified.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    sums = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = classes.select("cid", "key", "first_id", "copies").join(sums, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    of_class = settle(of_class.select("key", "first_id", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    smallest = of_class.where("component is not null").groupBy("component").agg(F.min("first_id").alias("smallest"))
    named = of_class.join(smallest, "component", "left").select(F.col("key").alias("__key"), F.coalesce("smallest", "first_id").alias("class_id"), "n_links")
    rows = sketched.select("doc_id", "key").join(named, F.col("key") == F.col("__key"), "left")
    class_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).cast(kind)
    return rows.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
