"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: each row is a shard of neighbouring documents
with, per term, the ascending positions where it stands.  Building it is a row
map; the shards are stored in the shared folder, so an executor that is lost
costs only the shards being read.  A phrase is searched in every shard from its
rarest terms: the shortest posting list, shifted by the term's place in the
phrase, is intersected with the next shortest until nothing or a match is left.
Proximity starts from the rarest term too and looks for the nearest postings of
the others.

Test items travel to the shards in blocks of bounded size.  When all items fit
one block only their terms are indexed; otherwise the index holds every term and
each block is searched in turn.

Defined results: a NULL or empty text has no words and is never contaminated; an
item without words has no windows; items with one id count once, an item without
id marks words but is not listed; repeated documents get a row each; an empty
table gives no rows, an empty benchmark marks nothing; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import lean, settle, text_or_empty, whole_groups

WINDOW = 13
SHARD_WORDS = 500_000
BLOCK_BYTES = 8 << 20

#: Bytes outside words become spaces, capitals become small: the rest is ``split``.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words of digits, letters and non-ASCII signs, A-Z lowered."""
    return text.encode().translate(_WORD_BYTES).split()


def build_index(docs: DataFrame, vocabulary: Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards (shard, doc_ids, n_words, terms, offsets, positions).

    Positions count all words of the shard's documents with one free place after
    each document, so no phrase runs from one into the next.  ``vocabulary``
    maps the terms to be indexed; ``None`` indexes all.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def shard_row(number: str, ids: list, counts: list[int], coded: list[np.ndarray], names: list[bytes]) -> dict:
        codes, counts_array = np.concatenate(coded), np.asarray(counts, np.int64)
        positions = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts_array)
        kept = np.flatnonzero(codes >= 0)
        order = kept[np.argsort(codes[kept], kind="stable")]
        terms, first = np.unique(codes[order], return_index=True)
        return {
            "shard": number,
            "doc_ids": ids,
            "n_words": counts_array,
            "terms": [names[t].decode() for t in terms],
            "offsets": np.append(first, len(order)).astype(np.int32),
            "positions": positions[order].astype(np.int32),
        }

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, made, size = TaskContext.get().partitionId(), 0, 0
        # Words are kept as numbers, by the vocabulary or in order of appearance in the shard.
        table: dict[bytes, int] = {} if vocabulary is None else vocabulary.value
        ids, counts, coded = [], [], []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].array, batch["text"]):
                own = words_of(text)
                if size and size + len(own) > SHARD_WORDS:
                    yield pd.DataFrame([shard_row(f"{part}-{made}", ids, counts, coded, list(table))])
                    ids, counts, coded, made, size = [], [], [], made + 1, 0
                    table = {} if vocabulary is None else table
                ids.append(None if doc is pd.NA else doc)
                counts.append(len(own))
                size += len(own)
                codes = map(table.get, own, repeat(-1)) if vocabulary is not None else (table.setdefault(w, len(table)) for w in own)
                coded.append(np.fromiter(codes, np.int32, len(own)))
        if ids:
            yield pd.DataFrame([shard_row(f"{part}-{made}", ids, counts, coded, list(table))])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"shard string, doc_ids array<{kind}>, n_words array<long>, terms array<string>, offsets array<int>, positions array<int>"
    return rows.mapInPandas(lean(index), schema)


class _Postings:
    """Posting lists of one shard."""

    def __init__(self, terms, offsets, positions):
        self.places = {t: i for i, t in enumerate(terms)}
        self.offsets, self.positions = np.asarray(offsets), np.asarray(positions)

    def count(self, term: str) -> int:
        at = self.places.get(term)
        return 0 if at is None else int(self.offsets[at + 1] - self.offsets[at])

    def of(self, term: str) -> np.ndarray:
        at = self.places[term]
        return self.positions[self.offsets[at] : self.offsets[at + 1]]

    def phrase(self, terms: tuple[str, ...]) -> np.ndarray:
        """Starts of the phrase."""
        counts = [self.count(t) for t in terms]
        if not all(counts):
            return np.empty(0, np.int32)
        order = sorted(range(len(terms)), key=counts.__getitem__)
        starts = self.of(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            shifted = self.of(terms[k])
            wanted = starts + k
            at = np.searchsorted(shifted, wanted)
            starts = starts[(at < len(shifted)) & (shifted[np.minimum(at, len(shifted) - 1)] == wanted)]
        return starts

    def near(self, terms: tuple[str, ...], within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most ``within`` places away."""
        counts = [self.count(t) for t in terms]
        if not all(counts):
            return np.empty(0, np.int32)
        rarest, *others = sorted(set(terms), key=self.count)
        found = self.of(rarest)
        for term in others:
            places = self.of(term)
            at = np.searchsorted(places, found)
            left = np.abs(found - places[np.maximum(at - 1, 0)])
            right = np.abs(found - places[np.minimum(at, len(places) - 1)])
            found = found[np.minimum(left, right) <= within]
        return found


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes`` of text, dealt by a hash of the text."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    return [rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else rows for b in range(blocks)]


def block_queries(block: DataFrame, window: int = WINDOW) -> dict[tuple[str, ...], list[str | None]]:
    """Distinct windows of one bounded block and the items that have them."""
    found: dict[tuple[str, ...], list[str | None]] = {}
    for item, text in block.toLocalIterator():
        words = [w.decode() for w in words_of(text)]
        for at in range(max(1, len(words) - window + 1) if words else 0):
            owners = found.setdefault(tuple(words[at : at + window]), [])
            if item not in owners:
                owners.append(item)
    return found


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans that cover the same places."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(new[1:] - 1, len(ends) - 1)]


_FOUND = "shard string, slot int, doc_id {kind}, n_words long, spans array<int>, items array<string>"


def search_phrases(index: DataFrame, queries: Broadcast) -> DataFrame:
    """For every document its words inside any queried phrase, as disjoint spans, and the owners of the phrases found."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = queries.value
        for batch in batches:
            for row in batch.itertuples(index=False):
                postings, n_words = _Postings(row.terms, row.offsets, row.positions), np.asarray(row.n_words)
                first = np.concatenate([[0], np.cumsum(n_words + 1)])
                starts, ends, owners = [], [], {}
                for terms, items in phrases.items():
                    at = postings.phrase(terms)
                    if len(at):
                        starts.append(at)
                        ends.append(at + len(terms))
                        for slot in np.unique(np.searchsorted(first, at, side="right") - 1):
                            owners.setdefault(int(slot), set()).update(x for x in items if x is not None)
                spans: dict[int, list[int]] = {}
                if starts:
                    begin, end = _joined(np.concatenate(starts), np.concatenate(ends))
                    for slot, b, e in zip(np.searchsorted(first, begin, side="right") - 1, begin, end):
                        spans.setdefault(int(slot), []).extend((int(b - first[slot]), int(e - first[slot])))
                slots = range(len(n_words))
                yield pd.DataFrame(
                    {
                        "shard": row.shard,
                        "slot": slots,
                        "doc_id": pd.Series(row.doc_ids, dtype=object),
                        "n_words": n_words,
                        "spans": [spans.get(s, []) for s in slots],
                        "items": [sorted(owners.get(s, ())) for s in slots],
                    }
                )

    return index.mapInPandas(lean(search), _FOUND.format(kind=kind))


def search_near(index: DataFrame, queries: Broadcast, within: int) -> DataFrame:
    """(doc_id, query, position) of every proximity match; ``queries`` maps names to term tuples."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                postings, n_words = _Postings(row.terms, row.offsets, row.positions), np.asarray(row.n_words)
                first = np.concatenate([[0], np.cumsum(n_words + 1)])
                found = []
                for name, terms in queries.value.items():
                    for at in postings.near(terms, within):
                        slot = int(np.searchsorted(first, at, side="right")) - 1
                        # The other terms must stand in the same document.
                        inside = lambda t: np.any((np.abs(p := postings.of(t) - at) <= within) & (p + at >= first[slot]) & (p + at < first[slot + 1]))  # noqa: B023, E731
                        if all(inside(t) for t in terms):
                            found.append((row.doc_ids[slot], name, int(at - first[slot])))
                yield pd.DataFrame(found, columns=["doc_id", "query", "position"])

    return index.mapInPandas(search, f"doc_id {kind}, query string, position int")


def _merge_blocks(found: DataFrame) -> DataFrame:
    """One row per document from the rows of several blocks."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, "place"):
            rows = []
            for _, group in frame.groupby("place", sort=False):
                flat = np.concatenate([np.asarray(s, np.int64) for s in group["spans"]]).reshape(-1, 2)
                begin, end = _joined(flat[:, 0], flat[:, 1]) if len(flat) else (flat[:, 0], flat[:, 1])
                one = group.iloc[0]
                rows.append((one["shard"], one["slot"], one["doc_id"], one["n_words"], np.stack([begin, end], 1).ravel(), sorted(set().union(*group["items"]))))
            yield pd.DataFrame(rows, columns=[c for c in frame.columns if c != "place"])

    kind = found.schema["doc_id"].dataType.simpleString()
    placed = found.withColumn("place", F.concat_ws("/", "shard", F.col("slot").cast("string")))
    return placed.repartition("place").sortWithinPartitions("place").mapInPandas(lean(merge), _FOUND.format(kind=kind))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, hit spans (word numbers, end exclusive, flattened) and the items found, for every document."""
    context = docs.sparkSession.sparkContext
    blocks = item_windows(items, window, item_id, block_bytes=block_bytes)
    vocabulary, queries = None, None
    if len(blocks) == 1:
        queries = block_queries(blocks[0], window)
        terms = sorted({t for phrase in queries for t in phrase})
        vocabulary = context.broadcast({t.encode(): i for i, t in enumerate(terms)})
    index = settle(build_index(docs, vocabulary, doc_id))
    found = None
    for block in blocks:
        shared = context.broadcast(queries if queries is not None else block_queries(block, window))
        one = search_phrases(index, shared)
        found = one if found is None else found.unionByName(one)
    if len(blocks) > 1:
        found = _merge_blocks(found)
    odd = F.filter("spans", lambda x, i: i % 2 == 1)
    even = F.filter("spans", lambda x, i: i % 2 == 0)
    n_hit = F.aggregate(F.zip_with(odd, even, lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")
