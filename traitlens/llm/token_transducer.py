"""Token counts by a compiled finite-state transducer.

A byte-fallback piece vocabulary merges the adjacent pair whose joined piece has
the best score, leftmost first, until no pair joins to a piece.  Such an encoding
is the only one in which every two neighbours stay apart when encoded alone, so
it can be followed from left to right: the last piece of a prefix is the one
piece that ends there and is a stable neighbour of the last piece before it.

``CountTransducer`` compiles this into a deterministic transducer, transition by
transition as texts need them.  A state is what can still matter: for every
suffix that some piece may continue, how it ends and how many tokens it lacks
from the prefix.  A transition carries the tokens it emits (the count of the
longer prefix less the count of the shorter; a merge can make it negative).

A character that no piece continues across sends every state to one start state.
So the map of a text chunk from states to states is fixed by its part before the
first such place, its tokens from there to the last one, and its part after it:
``ChunkMap``.  Maps compose associatively; a long text is cut into chunks whose
maps are folded as a prefix scan, in one task or over many rows.

Defined results: a NULL or empty text has no tokens; repeated rows get the same
count each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = 1 << 16
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n")
_CACHED_UNITS = 200_000
_LONG_UNIT = 64


class CountTransducer:
    """Deterministic automaton over characters whose transitions emit token counts.

    Compiled states are dropped and built anew once there are ``most_states``, so
    the table stays bounded however many texts pass.
    """

    def __init__(self, scores: dict[str, float], most_states: int = 200_000):
        self.scores, self.most_states = scores, most_states
        self.continued = {piece[:k] for piece in scores for k in range(1, len(piece))}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._stable: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        # A state is a tuple of (suffix, last piece before it or "", count there less count here), longest suffix first.
        self._states: list[tuple] = []
        self._numbers: dict[tuple, int] = {}
        self._moves: list[dict[str, tuple[int, int]]] = []
        self._stable.clear()
        self.start = self._number((("", "", 0),))

    def _number(self, state: tuple) -> int:
        number = self._numbers.get(state)
        if number is None:
            number = self._numbers[state] = len(self._states)
            self._states.append(state)
            self._moves.append({})
        return number

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Pieces of a short text by the merge rule itself, or the first ``until`` pieces it comes down to."""
        parts, none = list(text), float("-inf")
        while len(parts) > until:
            best = max(((self.scores.get(a + b, none), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(none, 0))
            if best[0] == none:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; for one character ("", ""); ``None`` if merges never make it."""
        if piece not in self._halves:
            if len(piece) == 1:
                self._halves[piece] = ("", "")
            else:
                two = self.merged(piece, until=2)
                self._halves[piece] = (two[0], two[1]) if len(two) == 2 and piece in self.scores else None
        return self._halves[piece]

    def stable(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay apart.

        Both are undone merge by merge, the later merge first.  While they were
        this small, would their inner neighbours have merged before the merge
        that took one of them away?
        """
        known = self._stable.get((left, right))
        if known is None:
            known = self._stable[left, right] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: str, right: str) -> bool:
        # Merges run by falling score, leftmost first: (-score, place) orders them; a merge across stands at place 1,
        # one inside the left piece at 0, one inside the right piece at 2.
        before = (float("inf"), 3)
        while True:
            across = self.scores.get(left + right)
            if across is not None and (-across, 1) < before:
                return False
            merge_left = (-self.scores[left], 0) if len(left) > 1 else (float("-inf"), 0)
            merge_right = (-self.scores[right], 2) if len(right) > 1 else (float("-inf"), 2)
            if len(left) == 1 and len(right) == 1:
                return True
            if merge_left > merge_right:
                before, left = merge_left, self.halves(left)[1]
            else:
                before, right = merge_right, self.halves(right)[0]

    def width(self, char: str) -> int:
        """Tokens of a character alone: one, or its bytes when no piece has it."""
        return 1 if char in self.scores else len(char.encode())

    def move(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the tokens emitted on the way."""
        found = self._moves[state].get(char)
        if found is None:
            found = self._moves[state][char] = self._compile(state, char)
        return found

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        entries, known = self._states[state], char in self.scores
        last, emitted = "", self.width(char)
        for suffix, before, lack in entries:
            piece = suffix + char
            if not suffix:
                last, emitted = (char if known else ""), lack + self.width(char)
            elif piece not in self.scores or self.halves(piece) is None:
                continue
            elif before and not self.stable(before, piece):
                continue
            else:
                last, emitted = piece, lack + 1
            break
        kept = [(suffix + char, before, lack - emitted) for suffix, before, lack in entries if suffix + char in self.continued]
        return self._number((*kept, ("", last, 0))), emitted

    def run(self, text: str) -> int:
        """Tokens emitted from the start state over a text."""
        if len(self._states) > self.most_states:
            self.reset()
        state, total, moves = self.start, 0, self._moves
        for char in text:
            step = moves[state].get(char) or self.move(state, char)
            state = step[0]
            total += step[1]
        return total


class _Counts(dict):
    """Tokens of a unit; many texts share their units."""

    def __init__(self, transducer: CountTransducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, unit: str) -> int:
        count = self.transducer.run(unit)
        if len(unit) <= _LONG_UNIT:
            if len(self) >= _CACHED_UNITS:
                self.clear()
            self[unit] = count
        return count


@dataclass(frozen=True)
class ChunkMap:
    """The map of one chunk: what stands before its first border, tokens between borders, what stands after the last.

    ``head`` is ``None`` when the chunk has no border: then ``tail`` is all of it.
    """

    head: str | None
    inner: int
    tail: str

    def then(self, right: ChunkMap, counts: _Counts) -> ChunkMap:
        if right.head is None:
            return ChunkMap(self.head, self.inner, self.tail + right.tail)
        if self.head is None:
            return ChunkMap(self.tail + right.head, right.inner, right.tail)
        return ChunkMap(self.head, self.inner + sum(counts[u] for u in _UNIT.findall(self.tail + right.head)) + right.inner, right.tail)

    def total(self, counts: _Counts) -> int:
        return self.inner + sum(counts[u] for part in (self.head or "", self.tail) for u in _UNIT.findall(part))


def chunk_map(chunk: str, counts: _Counts) -> ChunkMap:
    """Borders lie before a run of spaces and before and after a line end.

    The first and the last unit may go on in the next chunk and stay open.
    """
    units = _UNIT.findall(chunk)
    if len(units) < 2:
        return ChunkMap(None, 0, chunk)
    return ChunkMap(units[0], sum(map(counts.__getitem__, units[1:-1])), units[-1])


def count_text(text: str, counts: _Counts, chunk: int = CHUNK) -> int:
    """Tokens of a whole text: its chunk maps folded from the left."""
    if not text:
        return 0
    text = SPACE + text.replace(" ", SPACE)
    if len(text) <= chunk:
        return sum(map(counts.__getitem__, _UNIT.findall(text)))
    folded = chunk_map(text[:chunk], counts)
    for at in range(chunk, len(text), chunk):
        folded = folded.then(chunk_map(text[at : at + chunk], counts), counts)
    return folded.total(counts)


def piece_scores(model_file: str) -> dict[str, float]:
    """Pieces that merges may form, with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usual = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in usual}


@lru_cache(maxsize=2)
def counts_for(model_file: str) -> _Counts:
    """One transducer and its counts per process and model.

    Compiled states are many small tuples that stay; looking for cycles among them is wasted time.
    """
    gc.set_threshold(100_000, 50, 50)
    return _Counts(CountTransducer(piece_scores(model_file)))


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; a row map without a shuffle."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = counts_for(model_file)
        for batch in batches:
            yield pd.Series([count_text(t, counts) for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count.asNondeterministic()(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
