"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts words, and the first four and five letters of longer words, in labelled
texts. A token counts once for each pair of neighbours it has in a class, so a document's
copies add nothing. Log-odds with a Dirichlet prior (and their variance) say which tokens
mark the toxic class; those that are significant score the lower end of their interval,
every other token a fixed loss. One linear scan finds all maximal segments of a text. A
segment's score S is calibrated by the extreme-value law for maximal segments: by chance
a text of n tokens holds K n exp(-lambda S) segments as good, lambda being the root of
sum p(s) exp(lambda s) = 1 over the scores of clean training text, and K the value that
makes the best segments of the clean training texts likeliest under that law. A logistic
curve over the logarithm of that number, fitted on the sample, turns it into a probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, cut, fold_of

FOLDS, HELD_OUT = 5, 0
#: Most labelled rows that training reads; a model keeps every token of them that is significant.
SAMPLE_ROWS = 6_000
#: Count that the prior adds to a token in either class; standard errors that log-odds
#: must lie from zero (many tokens are tested), and the least lower end of their interval.
PRIOR = 1.0
Z = 4.0
LEAST_GAIN = 1.0
LOSS = -math.log(2)
#: A passage is reported if chance gives fewer as good ones than this.
SIGNIFICANT = 0.05
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 500_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> tuple[str, ...]:
    """The word, and its first letters where it is long enough for them to be a stem."""
    return (word, word[:5] + "~", word[:4] + "~") if len(word) > 5 else (word, word[:4] + "~") if len(word) > 4 else (word,)


def maximal_segments(scored: list[tuple[int, float]], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    scored lists the places and scores of the tokens with a gain; all others lose `loss`.
    Follows Ruzzo and Tompa: a stack of candidates with the sums before and up to each.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for place, gain in scored:
        total += loss * (place - last - 1)
        first, low, last = place, total, place
        total += gain
        while stack:
            at = len(stack) - 1
            while at >= 0 and stack[at][2] >= low:
                at -= 1
            if at < 0 or stack[at][3] >= total:
                break
            first, low = stack[at][0], stack[at][2]
            del stack[at:]
        stack.append((first, place, low, total))
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass
class Model:
    """Scores of tokens, and the constants of the extreme-value law."""

    lexicon: dict[str, float]
    lam: float
    k: float = 0.1
    loss: float = LOSS
    curve: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def gain(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            self.known[word] = found = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        return found

    def expected(self, score: float, n: int) -> float:
        """Segments as good that chance gives in n tokens."""
        return self.k * n * math.exp(-min(self.lam * score, 700.0))

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The text's number of words (1 at least), and all its maximal segments."""
        words, gain = words_of(text), self.gain
        return max(1, len(words)), maximal_segments([(i, g) for i, w in enumerate(words) if (g := gain(w))], self.loss)

    def evidence(self, n: int, scores: list[float]) -> float:
        """How unlikely chance makes segments of these scores in n tokens, as a negative logarithm.

        By chance the number of segments as good as the k-th best follows a Poisson law
        about their expected number; the k for which its tail is least counts. Without any
        segment there is no evidence, whatever the length.
        """
        x = 0.0
        for k, score in enumerate(sorted(scores, reverse=True), 1):
            if (chance := self.expected(score, n)) < k:
                x = max(x, chance + math.lgamma(k + 1) - k * math.log(chance))
        return x

    def passages(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score from 0 to 1, and its significant segments by tokens."""
        n, found = self.segments(text)
        x = self.evidence(n, [score for *_, score in found])
        significant = [f for f in found if self.expected(f[2], n) < SIGNIFICANT]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.curve[0] + self.curve[1] * x)))), significant


def _counts(sample: DataFrame) -> DataFrame:
    """token, toxic, clean: the distinct neighbourhoods that each token has in either class."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                seen = set()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = ["", *words_of(text or ""), ""]
                    seen.update((words[i - 1], words[i], words[i + 1], label) for i in range(1, len(words) - 1))
                rows = [(w, f"{a} {b}", label) for a, w, b, label in seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())],
                    names=["word", "around", "label"],
                )

    met = sample.select("text", "label").mapInArrow(each, "word string, around string, label int")
    met = met.groupBy("word", "label", F.xxhash64("around").alias("at")).agg(F.lit(1).alias("one"))
    by_word = met.groupBy("word", "label").agg(F.count("*").alias("n"))
    stems = F.when(F.length("word") > 5, F.array(F.col("word"), F.concat(F.substring("word", 1, 5), F.lit("~")), F.concat(F.substring("word", 1, 4), F.lit("~"))))
    stems = stems.when(F.length("word") > 4, F.array(F.col("word"), F.concat(F.substring("word", 1, 4), F.lit("~")))).otherwise(F.array("word"))
    return by_word.select(F.explode(stems).alias("token"), "label", "n").groupBy("token").agg(
        F.sum(F.when(F.col("label") > 0, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") > 0, 0).otherwise(F.col("n"))).alias("clean"),
    )


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most about sample_rows labelled rows outside the held-out fold."""
    taken = bounded_labels(labels, "toxic", sample_rows, folds=FOLDS, held_out=HELD_OUT)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    counts = cut(_counts(sample))
    words = counts.where(~F.col("token").endswith("~"))
    n_toxic, n_clean = (x or 0 for x in words.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_toxic or not n_clean:
        return Model({}, 1.0)
    odds = lambda y, n: F.log((F.col(y) + PRIOR) / (n - F.col(y) + PRIOR))
    scored = counts.where("toxic > 0").select(
        "token", "clean",
        (odds("toxic", n_toxic) - odds("clean", n_clean)).alias("delta"),
        F.sqrt(1 / (F.col("toxic") + PRIOR) + 1 / (F.col("clean") + PRIOR)).alias("error"),
    )
    marks = (F.col("delta") > Z * F.col("error")) & (F.col("delta") - 1.96 * F.col("error") >= LEAST_GAIN)
    # tokens of the bounded sample
    best = scored.where(marks).collect()
    lexicon = {r["token"]: r["delta"] - 1.96 * r["error"] for r in best}
    chance = [((r["clean"] + 0.5) / n_clean, lexicon[r["token"]]) for r in best]
    model = Model(lexicon, _lambda(chance))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.segments(text.as_py() or "") for text in batch.column(0)]
            scores = [[score for *_, score in own] for _, own in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array(scores, pa.list_(pa.float64())), batch.column(1)], names=["n", "scores", "label"])

    # the numbers of the bounded sample's segments
    seen = sample.select("text", "label").mapInArrow(each, "n long, scores array<double>, label int").collect()
    model.k = _extreme_k([(r["n"], max(r["scores"], default=0.0)) for r in seen if not r["label"]], model.lam)
    return Model(lexicon, model.lam, model.k, curve=logistic([(model.evidence(r["n"], r["scores"]), r["label"]) for r in seen]))


def _extreme_k(best: list[tuple[int, float]], lam: float) -> float:
    """The likeliest K of the law P(best < s) = exp(-K n exp(-lam s)), from (n, best score) of texts; no segment is a score of 0."""
    seen = sum(score > 0 for _, score in best)
    return (seen + 0.5) / max(1.0, sum(n * math.exp(-lam * score) for n, score in best))


def logistic(points: list[tuple[float, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope of the logistic curve through the points, by damped Newton steps."""
    x, y = np.array([p[0] for p in points]), np.array([p[1] > 0 for p in points], float)
    at, spread = x.mean(), x.std() or 1.0
    z = np.stack([np.ones_like(x), (x - at) / spread], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(w[0] - w[1] * at / spread), float(w[1] / spread)


def _lambda(chance: list[tuple[float, float]], loss: float = LOSS) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1, by bisection; 1 where there is none."""
    rest = 1 - sum(p for p, _ in chance)
    if not chance or rest <= 0 or sum(p * s for p, s in chance) + rest * loss >= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        above = sum(p * math.exp(min(mid * s, 600)) for p, s in chance) + rest * math.exp(mid * loss) > 1
        low, high = (low, mid) if above else (mid, high)
    return low


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_passages, passages.

    passages are the significant segments: first and last word (words from 0) and score.
    A null or empty text scores as one without evidence. Repeated rows each get their row, null identifiers
    stay, further columns are ignored, an empty table gives no rows.
    """
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                score, segments = model.passages(text.as_py() or "")
                scores.append(score)
                found.append([{"first": a, "last": b, "score": s} for a, b, s in segments])
            columns = [batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array(found, passage)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "passages"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    out = source.mapInArrow(each, "doc_id long, held_out boolean, score double, passages array<struct<first:long,last:long,score:double>>")
    return out.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages"
    )


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return apply(docs, fit(docs, labels, sample_rows))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text the model doesn't find toxic, with all their columns.

    A score of one half counts as toxic. A null text scores as an empty one. Repeated rows
    and rows without an identifier are judged each by itself; an empty table stays empty.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([model.passages(x.as_py() or "")[0] < 0.5 for x in text], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
