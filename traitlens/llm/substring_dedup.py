"""Substring deduplication by level-wise doubling.

A window of 20 words that repeats holds windows of 5 and of 10 words that repeat.
So the levels are 5, 10 and 20 words: at each length windows are counted over all
texts, and only where a window repeats are windows of twice the length looked at.
At the lower levels a 20-word window is represented by the smallest hash among
the shorter windows inside it; equal windows have equal representatives, so
nothing is lost and only about one place in eight is counted.

At the last level every surviving window is kept once, at its first place (by
document, then by position); words under any other occurrence are removed.

Texts that occur more than once are handled once.  They are stored bucketed by
their 128-bit address, so the passes over them move only hashes and positions.
Repeated windows inside a task are reduced to the first before the shuffle, so a
passage shared by a third of all documents costs one row per task and window.

Defined results: a NULL or empty text has no words; a text of fewer words than a
window keeps them all; repeated rows are the same document and keep the same
words; a NULL id comes after all others; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitlens.llm.common import new_folder, settle, text_or_empty, whole_groups
from traitlens.llm.word_hash import doubled, mixed, text_hashes, windows

WINDOW = 20
_BLOCK = 1_000_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, a, b) with the text's MD5 as two signed numbers."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.md5("text"))
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("long")
    return rows.select("doc_id", "text", half(1).alias("a"), half(17).alias("b"))


def stored_texts(rows: DataFrame) -> DataFrame:
    """Distinct texts (a, b, first_id, text), bucketed by address: later joins on it shuffle only the other side."""
    spark, name = rows.sparkSession, f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text"))
    texts.write.bucketBy(buckets, "a", "b").option("path", new_folder(spark, "texts")).saveAsTable(name)
    stored = spark.table(name)
    # The frame knows files and buckets by now; the name need not stay in the catalogue.
    spark.sql(f"DROP TABLE {name}")
    return stored


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of stages whose results are settled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _slide(values: np.ndarray, width: int, smaller) -> np.ndarray:
    """Least or greatest of each run of ``width`` neighbours, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = smaller(out[:-step], out[step:])
        reach += step
    return out


class _Levels:
    """Window hashes of one text at the lengths w/4, w/2 and w, and the representatives of its w-word windows."""

    def __init__(self, words: np.ndarray, window: int):
        quarter, half = window // 4, window // 2
        short = windows(words, quarter)
        middle = doubled(short, quarter)
        self.whole = doubled(middle, half)
        self.places = {quarter: mixed(short), half: mixed(middle)}
        self.chosen = {k: _slide(v, window - k + 1, np.minimum) for k, v in self.places.items()}

    def seeds(self, length: int, alive: np.ndarray | None = None) -> np.ndarray:
        """Places whose window represents some (surviving) whole window."""
        values, chosen = self.places[length], self.chosen[length]
        if alive is None:
            pad = np.zeros(len(values) - len(chosen), np.uint64)
            most = _slide(np.concatenate([pad, chosen, pad]), len(pad) + 1, np.maximum)
            return np.flatnonzero(most == values)
        return np.flatnonzero(np.isin(values, np.unique(chosen[alive])))

    def alive(self, length: int, places: np.ndarray) -> np.ndarray:
        """Whether each whole window's representative stands at one of the repeated places."""
        return np.isin(self.chosen[length], np.unique(self.places[length][places]))


def _each(batch: pd.DataFrame, window: int) -> Iterator[tuple[int, np.ndarray]]:
    for row, words in enumerate(text_hashes(batch["text"])):
        if len(words) >= window:
            yield row, words


def seed_places(texts: DataFrame, length: int, window: int, survivors: DataFrame | None = None) -> DataFrame:
    """(h, a, b, pos) of the windows of ``length`` words that represent whole windows.

    With ``survivors`` (a, b, places) of half the length, only of whole windows whose shorter representative repeats.
    """
    source = texts.select("a", "b", "text") if survivors is None else texts.select("a", "b", "text").join(survivors, ["a", "b"])

    lowest = survivors is None

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b, parts = batch["a"].to_numpy(), batch["b"].to_numpy(), []
            for row, words in _each(batch, window):
                levels = _Levels(words, window)
                alive = None if lowest else levels.alive(length // 2, np.asarray(batch["places"].iat[row]))
                at = levels.seeds(length, alive)
                parts.append((np.full(len(at), row), at, levels.places[length][at]))
            if parts:
                rows, at, h = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"h": h.view(np.int64), "a": a[rows], "b": b[rows], "pos": at.astype(np.int32)})

    return source.mapInPandas(seeds, "h long, a long, b long, pos int")


def repeated_places(seeds: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """(a, b, places): for each text its seeds whose hash occurs at least twice.

    Hashes are counted with map-side sums and the repeated ones settled, so both
    sides of the join back are plain exchanges: adaptive execution can split the
    places of one very common hash.
    """
    repeated = settle(seeds.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    kept = (seeds if again is None else again).join(repeated, "h")
    return settle(kept.groupBy("a", "b").agg(F.collect_list("pos").alias("places")))


def later_windows(texts: DataFrame, survivors: DataFrame, window: int) -> DataFrame:
    """(a, b, pos, run): runs of window starts whose word sequence starts earlier elsewhere."""
    source = texts.select("a", "b", "first_id", "text").join(survivors, ["a", "b"])
    kind = texts.schema["first_id"].dataType.simpleString()
    schema = f"h long, first_id {kind}, a long, b long, pos int, run int"

    def block(parts: list) -> pd.DataFrame:
        h, first, a, b, pos = (np.concatenate(x) for x in zip(*parts))
        ids = pd.Series(first)
        order_of = ids.rank(method="dense", na_option="bottom").to_numpy()
        order = np.lexsort((pos, b, a, order_of, h))
        first_one = np.append(True, h[order][1:] != h[order][:-1])
        frames = [pd.DataFrame({"h": h[order][first_one], "first_id": ids.to_numpy()[order][first_one], "a": a[order][first_one], "b": b[order][first_one], "pos": pos[order][first_one], "run": 0})]
        rest = order[~first_one]
        if len(rest):
            ra, rb, rp = a[rest], b[rest], pos[rest]
            by_place = np.lexsort((rp, rb, ra))
            ra, rb, rp = ra[by_place], rb[by_place], rp[by_place]
            new = np.flatnonzero(np.append(True, (ra[1:] != ra[:-1]) | (rb[1:] != rb[:-1]) | (rp[1:] != rp[:-1] + 1)))
            runs = np.diff(np.append(new, len(rp)))
            # Known to be later already: they only travel to their own text.
            frames.append(pd.DataFrame({"h": ra[new] ^ rp[new], "first_id": None, "a": ra[new], "b": rb[new], "pos": rp[new], "run": runs}))
        out = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        return out.astype({"pos": np.int32, "run": np.int32})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for batch in batches:
            a, b, first = batch["a"].to_numpy(), batch["b"].to_numpy(), batch["first_id"].to_numpy()
            for row, words in _each(batch, window):
                levels = _Levels(words, window)
                at = np.flatnonzero(levels.alive(window // 2, np.asarray(batch["places"].iat[row])))
                if len(at):
                    n = len(at)
                    parts.append((levels.whole[at].view(np.int64), np.repeat(first[row : row + 1], n), np.repeat(a[row], n), np.repeat(b[row], n), at))
                    size += n
                if size >= _BLOCK:
                    yield block(parts)
                    parts, size = [], 0
        if parts:
            yield block(parts)

    def later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "h"):
            # The first row of a hash without a run is its earliest place.
            candidate = frame["run"].to_numpy() == 0
            h = frame["h"].to_numpy()
            firsts = pd.Series(h[candidate]).duplicated().to_numpy()
            keep = ~candidate
            keep[np.flatnonzero(candidate)[firsts]] = True
            out = frame.loc[keep, ["a", "b", "pos", "run"]]
            yield out.assign(run=out["run"].clip(lower=1))

    rows = source.mapInPandas(emit, schema).repartition("h")
    ordered = rows.sortWithinPartitions("h", F.col("first_id").asc_nulls_last(), "a", "b", "pos")
    return ordered.mapInPandas(later, "a long, b long, pos int, run int")


def deduplicated(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row; see ``kept_words`` for digests only.

    ``window`` must be a multiple of 4.
    """
    return _kept(docs, window, id_col, text_col, digest=False)


def kept_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return _kept(docs, window, id_col, text_col, digest=True)


def _kept(docs: DataFrame, window: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    if window % 4:
        raise ValueError("window must be a multiple of 4")
    spark, rows = docs.sparkSession, addressed(docs, id_col, text_col)
    texts = stored_texts(rows)
    release(spark)
    quarter = repeated_places(seed_places(texts, window // 4, window))
    release(spark)
    seeds = settle(seed_places(texts, window // 2, window, quarter))
    half = repeated_places(seeds)
    release(spark)
    covered = settle(later_windows(texts, half, window).groupBy("a", "b").agg(F.collect_list("pos").alias("at"), F.collect_list("run").alias("runs")))
    release(spark)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, at, runs in zip(batch["text"], batch["at"], batch["runs"]):
                words, removed = text.encode().split(), 0
                n = len(words)
                if at is not None:
                    at, edge = np.asarray(at, np.int64), np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.asarray(runs, np.int64) + window - 1, -1)
                    gone = np.cumsum(edge[:n]) > 0
                    removed = int(gone.sum())
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out.append((n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
            found = pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])
            yield pd.concat([batch[["a", "b", "first_id"]].reset_index(drop=True), found], axis=1)

    kind = texts.schema["first_id"].dataType.simpleString()
    result = texts.join(covered, ["a", "b"], "left").select("a", "b", "first_id", "text", "at", "runs")
    result = result.mapInPandas(keep, f"a long, b long, first_id {kind}, n_words long, n_removed long, kept string")
    joined = rows.select("doc_id", "a", "b").join(result, ["a", "b"])
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("n_words") >= window)
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY if digest else "")).otherwise(F.col("kept")).alias("kept_sha256" if digest else "kept_text"),
    )
