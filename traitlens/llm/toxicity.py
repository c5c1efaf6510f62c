"""Toxicity by weak supervision.

Many voters look at a text: words of a fixed lexicon, word beginnings and words
that labelled rows tie to toxic or clean texts, the absence of all of them, and
the annotator whose labels are given.  A generative label model estimates by
expectation maximisation how often each voter speaks in toxic and in clean texts
and, from what is left after that, how strongly voters speak together; voters
that repeat each other share one vote.  Its posterior labels train a linear
classifier over the presence of the selected words and beginnings, which scores
every text.

Training uses a sample of about ``SAMPLE`` labelled rows, even between the
labels; scoring is a row map over all whole texts.

Defined results: a NULL or empty text scores as one without any sign; without
labelled rows the fixed lexicon alone decides; repeated rows get one score;
labels without a document, NULL labels and NULL ids are ignored in training; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import held_out, settle, text_or_empty

#: Bound of the labelled sample that training reads, in expectation.
SAMPLE = 5_000
VOTERS = 200
#: How often the annotator is taken to be right.
ANNOTATOR = 0.95
FEATURES = 1_024
FULL_RATE = 30
#: Word beginnings of these lengths are candidate patterns, besides whole words.
BEGINNINGS = range(4, 8)
_LEAST_DOCS = 5
_WORD = re.compile(r"[^\W\d_]+")
_CACHED_WORDS = 300_000

# Common English insults.
LEXICON = (
    "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown imbecile retard bastard bitch "
    "whore slut asshole jerk freak vermin filth garbage subhuman degenerate parasite cretin dimwit"
).split()


def patterns_of(word: str) -> list[str]:
    """The word itself, marked by ``=``, and its beginnings."""
    return ["=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


class _Hits(dict):
    """Which selected patterns a word has."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        hits = tuple(self.numbers[p] for p in patterns_of(word) if p in self.numbers)
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = hits
        return hits

    def of(self, text: str) -> dict[int, float]:
        """The patterns present and how much of the text has each: the whole from one word in ``FULL_RATE`` on."""
        words = _WORD.findall(text.lower())
        counts: dict[int, int] = {}
        for word in filter(None, map(self.__getitem__, words)):
            for i in word:
                counts[i] = counts.get(i, 0) + 1
        return {i: min(1.0, n * FULL_RATE / len(words)) for i, n in counts.items()}

    def vector(self, text: str) -> np.ndarray:
        """Presence of every pattern, then its rate."""
        out, n = np.zeros(2 * len(self.numbers), np.float32), len(self.numbers)
        for i, rate in self.of(text).items():
            out[i], out[n + i] = 1, rate
        return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(row, text, toxic) of a bounded sample of labelled rows that are not held out.

    The sampled labels are bounded, so they are broadcast and no text is shuffled.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("toxic") == label, F.lit(sample / 2 / n)).otherwise(share)
    drawn = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(drawn), "doc_id")
    # Rows that share an id are one labelled document.
    return settle(texts.groupBy("doc_id", "toxic").agg(F.first("text").alias("text")).select(F.monotonically_increasing_id().alias("row"), "text", "toxic"))


def pattern_counts(train: DataFrame) -> DataFrame:
    """(pattern, toxic, clean): in how many texts of each label a pattern occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"]):
                found[label].update({p for w in words_of(text) for p in patterns_of(w)})
        names = list(found[0].keys() | found[1].keys())
        yield pd.DataFrame({"pattern": names, "toxic": [found[1][p] for p in names], "clean": [found[0][p] for p in names]})

    part = train.select("text", "toxic").mapInPandas(count, "pattern string, toxic long, clean long")
    summed = part.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    return summed.where(F.col("toxic") + F.col("clean") >= _LEAST_DOCS)


def select_patterns(counts: DataFrame, toxic: int, clean: int, most: int = FEATURES) -> list[tuple[str, float]]:
    """Patterns most surely tied to one label, with the sign and strength of the tie."""
    share = toxic / max(1, toxic + clean)
    n = F.col("toxic") + F.col("clean")
    score = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share) + 1e-9)
    # A report of the strongest: the limit is the feature.
    rows = counts.withColumn("score", score).orderBy(F.abs("score").desc(), "pattern").limit(most).select("pattern", "score")
    return [(r["pattern"], r["score"]) for r in rows.collect()]


@dataclass(frozen=True)
class LabelModel:
    """How often each voter speaks in toxic and clean texts, the share of toxic texts, and each voter's weight."""

    in_toxic: np.ndarray
    in_clean: np.ndarray
    share: float
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A silent voter abstains, which says nothing; that all are silent is a vote of its own."""
        odds = votes @ (np.log(self.in_toxic / self.in_clean) * self.weight) + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> LabelModel:
    """Expectation maximisation, begun at the annotator's labels.

    The last two columns are the annotator's votes; their rates stay at
    ``ANNOTATOR`` and the share of toxic texts stays the labels' own, which keeps
    the classes from drifting.  After each round the correlation of voters within
    the two classes is taken from what their rates leave unexplained; a voter's
    weight is one over the sum of its squared correlations with the other voters,
    so k copies of a voter weigh as one.
    """
    p, n = np.where(labels == 1, ANNOTATOR, 1 - ANNOTATOR), len(votes)
    share, model = float(np.clip(np.mean(labels == 1), 0.01, 0.99)), None
    for _ in range(rounds):
        in_toxic = (p @ votes + 0.2) / (p.sum() + 1)
        in_clean = ((1 - p) @ votes + 0.2) / ((1 - p).sum() + 1)
        left = votes - (p[:, None] * in_toxic + (1 - p)[:, None] * in_clean)
        covariance = left.T @ left / max(n, 1)
        scale = np.sqrt(np.diag(covariance)) + 1e-9
        correlation = np.clip(covariance / scale[:, None] / scale, 0, 1)
        correlation[-2:], correlation[:, -2:] = 0, 0
        weight = 1 / np.maximum(1.0, (correlation**2).sum(axis=1))
        in_toxic[-2:], in_clean[-2:] = (ANNOTATOR, 1 - ANNOTATOR), (1 - ANNOTATOR, ANNOTATOR)
        model = LabelModel(in_toxic, in_clean, share, weight)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = np.clip(new, 0.001, 0.999)
    return model


@dataclass(frozen=True)
class Scorer:
    """A linear classifier over the presence and the rates of patterns."""

    patterns: tuple[str, ...]
    weights: np.ndarray
    intercept: float

    def hits(self) -> _Hits:
        return _Hits({p: i for i, p in enumerate(self.patterns)})


def lexicon_scorer() -> Scorer:
    return Scorer(tuple("=" + w for w in LEXICON), np.repeat([4.0, 0.0], len(LEXICON)), -3.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Voters, label model and classifier from the labelled sample."""
    rows = training_rows(docs, labels, sample)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return lexicon_scorer()
    chosen = select_patterns(pattern_counts(rows), sizes[1], sizes[0])
    patterns = list(dict.fromkeys([*(p for p, _ in chosen), *("=" + w for w in LEXICON)]))
    scores = dict(chosen)
    ranked = sorted(scores, key=lambda p: -abs(scores[p]))
    lexicon = [p for p in patterns if p.removeprefix("=") in LEXICON and p.startswith("=")]
    voters = list(dict.fromkeys([*lexicon, *[p for p in ranked if scores[p] > 3], *[p for p in ranked if scores[p] < -3][: VOTERS // 10]]))[:VOTERS]
    numbers = {p: i for i, p in enumerate(patterns)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits = _Hits(numbers)
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "toxic": batch["toxic"], "features": [hits.vector(t) for t in batch["text"]]})

    encoded = settle(rows.mapInPandas(present, "row long, toxic int, features array<float>"))
    # Bounded: the voters' part of each sampled row.
    spoken = F.transform(F.array(*[F.lit(numbers[v] + 1) for v in voters]), lambda i: F.element_at("features", i))
    local = encoded.select("row", "toxic", spoken.alias("spoken")).toPandas()
    votes = np.zeros((len(local), len(voters) + 3))
    votes[:, :-3] = np.stack(local["spoken"])
    toxic_voters = [k for k, v in enumerate(voters) if scores.get(v, 1.0) > 0]
    votes[:, -3] = votes[:, toxic_voters].sum(axis=1) == 0
    votes[:, -2], votes[:, -1] = local["toxic"], 1 - local["toxic"]
    model = fit_label_model(votes, local["toxic"].to_numpy())
    local["posterior"] = model.posterior(votes)
    spark = docs.sparkSession
    posteriors = spark.createDataFrame(local[["row", "posterior"]])
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight"))))
    examples = encoded.join(F.broadcast(posteriors), "row").select("features", both.alias("e")).where("e.weight > 0.01")
    examples = examples.select(array_to_vector("features").alias("features"), "e.label", "e.weight").cache()
    fitted = LogisticRegression(maxIter=60, regParam=0.0005, standardization=False, weightCol="weight").fit(examples)
    examples.unpersist()
    return Scorer(tuple(patterns), fitted.coefficients.toArray(), float(fitted.intercept))


def scored(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; a row map without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value
        hits, n = scorer.hits(), len(scorer.patterns)
        present, rate = scorer.weights[:n].tolist(), scorer.weights[n:].tolist()
        for batch in batches:
            sums = [scorer.intercept + sum(present[i] + r * rate[i] for i, r in hits.of(t).items()) for t in batch]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.asarray(sums, float), -500, 500))))

    return docs.select(F.col(id_col).alias("doc_id"), score.asNondeterministic()(text_or_empty(text_col)).alias("score"))
