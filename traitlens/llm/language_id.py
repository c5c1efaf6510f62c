"""Language identification by hierarchical discrimination.

A text is the frequencies of its hashed letter n-grams.  A multinomial linear
classifier predicts the language family; within a family, one linear support
vector machine per pair of languages votes.

Families come from a fixed table of related languages; a language outside it is a
family of its own.  Training reads a bounded sample: about ``SAMPLE`` labelled
rows per language.  Prediction is a row map over whole texts.

Defined results: a text that is NULL or has no letter is ``und`` with score 0;
without any labelled row all texts are; repeated rows get one prediction; rows
with a NULL language are not learned from; an empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import held_out, lean, settle, text_or_empty

UNDETERMINED = "und"
#: Labelled rows per language that training reads, in expectation.
SAMPLE = 800
BUCKETS = 2_048
_CHUNK = 1 << 18
_TEXTS = 256

# ISO 639-1 codes of related languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af yi",
    "romance": "fr es it pt ro ca gl oc rm wa",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az uz kk ky tk tt",
    "iranian": "fa ps ku tg",
    "indic": "hi ur bn pa mr gu ne si",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.lower().replace("_", "-").split("-")[0], language)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_vector(text: str | None) -> np.ndarray | None:
    """Square roots of the frequencies of 1-, 2- and 3-grams of lowered letters, other signs as one gap; ``None`` without letters.

    Long texts are counted in chunks.
    """
    if not text:
        return None
    counts, letters, seen = np.zeros(BUCKETS), _letters(), False
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le"), np.uint32)
        codes = np.concatenate([[0], np.where(letters[codes], codes, 0), [0]]).astype(np.uint64)
        inside = codes > 0
        codes = codes[inside | np.append(True, inside[:-1])]
        if not codes.any():
            continue
        seen = True
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = two[:-1] * np.uint64(0x94D049BB133111EB) + one[2:]
        for grams in (one, two, three):
            grams = grams ^ (grams >> np.uint64(32))
            counts += np.bincount(((grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(53)).astype(np.int64), minlength=BUCKETS)
    return np.sqrt(counts / counts.sum()) if seen else None


@dataclass
class LanguageModel:
    """Family classifier rows and pairwise machines as plain arrays."""

    languages: dict[str, list[str]]
    family_weights: np.ndarray | None = None
    family_bias: np.ndarray | None = None
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's probability times the weakest of the winner's pairwise confidences."""
        families = list(self.languages)
        if self.family_weights is None:
            odds = np.ones((len(vectors), 1))
        else:
            raw = vectors @ self.family_weights.T + self.family_bias
            raw = np.exp(raw - raw.max(axis=1, keepdims=True))
            odds = raw / raw.sum(axis=1, keepdims=True)
        best = odds.argmax(axis=1)
        found = np.full(len(vectors), "", object)
        scores = odds[np.arange(len(vectors)), best]
        for f, family in enumerate(families):
            rows, members = np.flatnonzero(best == f), self.languages[family]
            if not len(rows):
                continue
            votes, margins = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            least = np.full((len(rows), len(members)), np.inf)
            for i, j in combinations(range(len(members)), 2):
                weights, bias = self.pairs[members[i], members[j]]
                margin = vectors[rows] @ weights + bias
                for k, m in ((i, margin), (j, -margin)):
                    votes[:, k] += m > 0
                    margins[:, k] += m
                    least[:, k] = np.minimum(least[:, k], m)
            # Equal votes are decided by the sum of margins.
            winner = (votes + 0.5 / (1 + np.exp(-np.clip(margins, -500, 500)))).argmax(axis=1)
            found[rows] = np.asarray(members, object)[winner]
            weakest = least[np.arange(len(rows)), winner]
            scores[rows] *= np.where(np.isinf(weakest), 1.0, 1 / (1 + np.exp(-2 * np.clip(weakest, -30, 30))))
        return found.tolist(), scores


def training_vectors(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(lang, features) of about ``sample`` rows of each language, none held out.

    Rows are drawn by a hash of id and text, so rows that share an id are drawn each by its own text and
    rows equal in both count once.  The row with the smallest hash is always drawn: no language is lost.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")).withColumn("__draw", F.xxhash64("doc_id", "text", F.lit(3)))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("__draw").alias("first")).collect()
    chosen = F.lit(False)
    for r in counts:
        drawn_hash = (F.pmod("__draw", F.lit(1 << 20)) < sample / r["n"] * (1 << 20)) | (F.col("__draw") == r["first"])
        chosen = F.when(F.col("lang") == r["lang"], drawn_hash).otherwise(chosen)
    drawn = usable.where(chosen).groupBy("lang", "__draw").agg(F.first("text").alias("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = [ngram_vector(t) for t in batch["text"]]
            keep = [v is not None for v in vectors]
            yield pd.DataFrame({"lang": batch["lang"][keep], "features": [v.astype(np.float32) for v in vectors if v is not None]})

    return settle(drawn.mapInPandas(lean(encode), "lang string, features array<float>"))


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """``docs`` has doc_id, text and lang; both levels are fitted by MLlib on the settled sample."""
    rows = training_vectors(docs, sample)
    known = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for language in known:
        families.setdefault(family_of(language), []).append(language)
    model = LanguageModel(families)
    if not known:
        return model
    vectors = rows.select("lang", array_to_vector("features").alias("features")).cache()
    numbered = lambda classes: F.element_at(F.create_map(*[F.lit(x) for k, v in classes.items() for x in (k, float(v))]), F.col("lang"))
    if len(families) > 1:
        number = {language: i for i, family in enumerate(families) for language in families[family]}
        fitted = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False).fit(vectors.withColumn("label", numbered(number)))
        model.family_weights, model.family_bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    for members in families.values():
        for a, b in combinations(members, 2):
            pair = vectors.where(F.col("lang").isin(a, b)).withColumn("label", numbered({a: 1, b: 0}))
            fitted = LinearSVC(maxIter=40, regParam=1e-4, standardization=False).fit(pair)
            model.pairs[a, b] = (fitted.coefficients.toArray(), float(fitted.intercept))
    vectors.unpersist()
    return model


def language_of(model: LanguageModel, context: SparkContext) -> Callable[[Column], Column]:
    """A function of a text Column that gives struct (lang_pred, score)."""
    shared = context.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @lean
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            languages, scores, texts = [UNDETERMINED] * len(batch), np.zeros(len(batch)), batch.tolist()
            for at in range(0, len(texts) if model.languages else 0, _TEXTS):
                vectors = [ngram_vector(t) for t in texts[at : at + _TEXTS]]
                rows = [at + k for k, v in enumerate(vectors) if v is not None]
                if rows:
                    found, confidence = model.predict(np.stack([v for v in vectors if v is not None]))
                    scores[rows] = confidence
                    for row, language in zip(rows, found):
                        languages[row] = language
            yield pd.DataFrame({"lang_pred": languages, "score": scores})

    # Not to be computed again where a filter on it is pushed down.
    return identify.asNondeterministic()


def predicted(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; a row map without a shuffle."""
    identify = language_of(model, docs.sparkSession.sparkContext)
    return docs.select(F.col(id_col).alias("doc_id"), identify(text_or_empty(text_col)).alias("p")).select("doc_id", "p.*")


def accepted(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is determined with at least this score, all columns kept."""
    identify = language_of(model, docs.sparkSession.sparkContext)
    judged = docs.withColumn("__language", identify(text_or_empty(text_col)))
    return judged.where((F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.score") >= least)).drop("__language")
