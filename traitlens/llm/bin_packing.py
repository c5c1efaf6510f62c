"""Best-fit packing by minimum bin slack, planned over lengths instead of documents.

Documents become token pieces of at most ``capacity`` tokens.  A bin's fullest
combination depends only on how many pieces of each length are left, and there
are at most ``capacity`` lengths, so the plan is made from a histogram: the
largest length left is placed, a bitset subset-sum over the lengths left finds
the fullest completion, and the combination is removed as many times as its
lengths allow.  Each combination uses up at least one length, so the plan has at
most ``capacity`` combinations whatever the number of documents.

Pieces then take their places: the r-th piece of a length goes to the r-th place
for that length.  Its rank is its place within its file part plus the number of
such pieces in earlier parts, so no window spans all pieces of a length.

Defined results: a NULL or empty text is one piece, the end id; repeated rows are
documents of their own; a NULL id is kept; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import compress
from operator import add, attrgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitlens.llm.common import lean, settle, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Words of one generation; two are kept, until the task ends.
_CACHED_WORDS = 300_000
_JOINED = 1_000
_JOINED_LETTERS = 5_000
_BETWEEN = b"<|endoftext|>"
_TEXTS = 500


class WordIds:
    """Token ids of texts as little-endian 32-bit bytes, word by word.

    The tokenizer lowers letters, drops white space and never merges across a
    change between letters and other signs.  So ids of a text are the ids of its
    words between ASCII white space, one after another; signs that end a word of
    letters are encoded apart from it, and ASCII letters may be lowered first
    unless the text holds the beginning of a special token.
    """

    def __init__(self, tokenizer_file: str):
        # One thread per task: Spark runs the tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.between = self.tokenizer.token_to_id(_BETWEEN.decode())
        parts = json.loads(self.tokenizer.to_str())
        #: Whether normalizer and splitter do no more to a word of letters than ``_letters`` does.
        self.plain = (parts["normalizer"], parts["pre_tokenizer"]) == (_NORMALIZER, _SPLITTER)
        self.known: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        raw = text.encode()
        return (raw if b"<|" in raw else raw.lower()).split()

    @staticmethod
    def _bytes(encoding) -> bytes:
        return np.asarray(encoding.ids, dtype="<u4").tobytes()

    def _joined(self, words: list[bytes], between: bytes) -> bytes:
        return self._bytes(self.tokenizer.encode_batch_fast([between.join(words).decode()], add_special_tokens=False)[0])

    def _letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of words of letters only, by the tokenizer's model alone where that is known to be enough."""
        if not self.plain:
            yield from self._encoded(words)
            return
        tokens_of = self.tokenizer.model.tokenize
        for at in range(0, len(words), _JOINED_LETTERS):
            some = words[at : at + _JOINED_LETTERS]
            # Each byte is one sign to the model; capitals of Latin-1 are still to be lowered.
            signs = b" ".join(some).decode().lower().encode().decode("latin-1")
            for byte, sign in _MODEL_SIGNS.items():
                signs = signs.replace(byte, sign)
            tokens, ends = [], [0]
            for word in signs.split(" "):
                tokens += tokens_of(word)
                ends.append(4 * len(tokens))
            raw = np.fromiter(map(_ID_OF, tokens), "<u4", len(tokens)).tobytes()
            yield from zip(some, map(raw.__getitem__, map(slice, ends, ends[1:])))

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of any words without a special token: joined by one, and cut there."""
        for at in range(0, len(words), _JOINED):
            some = words[at : at + _JOINED]
            ids = self._joined(some, _BETWEEN)
            cuts = (4 * np.flatnonzero(np.frombuffer(ids, "<u4") == self.between)).tolist()
            yield from zip(some, (ids[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(ids)])))

    def _learn(self, words: Iterable[bytes]) -> None:
        """Add words that are not known; signs at their ends are looked up apart."""
        known, letters, others = self.known, set(), set()
        words = list(words)
        # Two lists in place of one of pairs: nothing here for the garbage collector to follow.
        with_signs = [w for w in words if w[-1] in _SIGNS]
        stems = [w.rstrip(_SIGNS) for w in with_signs]
        parted = [bool(_LETTER.search(s)) for s in stems]
        with_signs, stems = list(compress(with_signs, parted)), list(compress(stems, parted))
        ends = [w[len(s) :] for w, s in zip(with_signs, stems)]
        for word in {*words, *stems, *ends}.difference(with_signs, known):
            (letters if word.isalpha() or _LETTERS.fullmatch(word) else others).add(word)
        known.update(self._letters(list(letters)))
        known.update(self._encoded([w for w in others if b"<|" not in w]))
        odd = [w for w in others if b"<|" in w]
        known.update(zip(odd, (self._bytes(e) for e in self.tokenizer.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False))))
        known.update(zip(with_signs, map(add, map(known.__getitem__, stems), map(known.__getitem__, ends))))

    def of(self, texts: Iterable[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > _CACHED_WORDS:
            # What a full generation knew is looked up once more, so frequent words outlive it.
            self.known, self.earlier = {}, self.known
            new = set().union(*split)
        again = new.intersection(self.earlier)
        self.known.update(zip(again, map(self.earlier.__getitem__, again)))
        self._learn(new - again)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def forget(self) -> None:
        """Drop the words; the tokenizer stays."""
        self.known, self.earlier = {}, {}


_ID_OF = attrgetter("id")
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: The bytes of lowered Latin-1 letters for which the model's byte alphabet has another sign.
_MODEL_SIGNS = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}
#: ASCII signs but those of special tokens, a letter of ASCII or Latin-1 at the end, and words of such letters.
_SIGNS = rb"""!"#$%&'()*+,-./:;=?@[\]^_`{}~"""
_LETTER = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


@lru_cache(maxsize=2)
def word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and where the piece stands: its file part and its rank there among its length.

    A row map without a shuffle; ids leave the task only as checksums.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        ids, seen, part = word_ids(tokenizer_file), [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            docs_ids = (x for at in range(0, len(batch), _TEXTS) for x in ids.of(batch["text"].iloc[at : at + _TEXTS]))
            for doc, own in zip(batch["doc_id"].array, docs_ids):
                own += end
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    body = own[at : at + 4 * capacity]
                    length = len(body) // 4
                    rows.append((doc, piece, at // 4, length, zlib.crc32(body), part, seen[length]))
                    seen[length] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part"])
        ids.forget()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank_in_part long"
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(lean(cut), schema)


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths whose sum is the largest not above ``room``, each at most as often as counted.

    Bit s of ``reach`` tells that sum s is reachable.  Counts enter in powers of
    two, so a length costs few shifts; larger lengths come first and the search
    ends once the room can be filled.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * times
            total -= length * times
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how many bins take each, by minimum bin slack."""
    left, plan = {k: n for k, n in histogram.items() if n > 0}, []
    while left:
        first = max(left)
        rest = dict(left)
        rest[first] -= 1
        combination = [first, *fullest(capacity - first, rest)]
        uses = {x: combination.count(x) for x in set(combination)}
        bins = min(left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            left[x] -= bins * n
            if not left[x]:
                del left[x]
        plan.append((sorted(combination, reverse=True), bins))
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length the runs of its ranks: first rank, pieces of this length per bin, first bin, offset of the first one.

    Pieces of one length stand side by side in a bin.
    """
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first_bin = 0
    for combination, bins in plan:
        offset = 0
        for length in sorted(set(combination), reverse=True):
            per_bin = combination.count(length)
            found.setdefault(length, []).append((taken.get(length, 0), per_bin, first_bin, offset))
            taken[length] = taken.get(length, 0) + per_bin * bins
            offset += per_bin * length
        first_bin += bins
    names = ("rank", "per_bin", "bin", "offset")
    return {k: dict(zip(names, np.asarray(v, dtype=np.int64).T)) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and offset there.

    The driver holds one count per length and the plan; both are bounded by the
    capacity.  Tokens are made once; the settled pieces carry checksums only.
    """
    cut = settle(pieces(docs, tokenizer_file, capacity, id_col, text_col))
    in_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # One row per length and file part: the window's groups grow with the number of parts, not of pieces.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = in_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(plan_bins(histogram, capacity)))
    kind = cut.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = shared.value
        for batch in batches:
            length = batch["length"].to_numpy()
            rank = (batch["base"] + batch["rank_in_part"]).to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for one in np.unique(length):
                rows, run = np.flatnonzero(length == one), runs[int(one)]
                at = np.searchsorted(run["rank"], rank[rows], side="right") - 1
                inside = rank[rows] - run["rank"][at]
                sequence[rows] = run["bin"][at] + inside // run["per_bin"][at]
                offset[rows] = run["offset"][at] + inside % run["per_bin"][at] * one
            yield batch.assign(sequence_id=sequence, offset=offset)[columns]

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return cut.join(bases, ["length", "part"]).mapInPandas(lean(place), schema)
