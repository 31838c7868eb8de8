"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is described by shares of character classes, word lengths and
repetition, by the same of the lines before and after it, and gets a label, good or bad.
A chain of two states with learned transitions joins the lines; forward-backward
marginals give each line's probability of being good. Their mean by line length is the
document's quality, which a logistic curve fitted on the sample calibrates.

Labels are those of whole documents; which lines make a document bad isn't told. Line
labels are therefore latent in training: a good document is one whose lines are all good,
a bad one has a bad line at least. The likelihood of the documents' labels has the
expected lines and moves given the label, less those without it, as its slope; given a bad
label these are the marginals without the path on which all lines are good. The first
steps take the document's label for each line, which only sets where the climb begins.
Training reads a bounded sample outside the held-out fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, fold_of
from .toxicity import logistic

FOLDS, HELD_OUT = 4, 2
#: Most labelled documents, and most lines of them, that training reads.
SAMPLE_ROWS = 2_000
SAMPLE_LINES = 200_000
THRESHOLD = 0.7
#: Share of the training steps that take a document's label for its lines.
WARM = 0.3
#: Score by which lines of bad documents are held to be good before they are looked at: a bad
#: document needs one bad line, and nothing else speaks for more of them than its lines do.
LENIENCE = 0.5
#: Texts that are described together: so many, and so many bytes, at most (one text may be longer).
_PART, _PART_BYTES = 128, 1 << 20

# Character classes whose share of a line's bytes is a feature (fixed values).
_CLASSES = [b"#*$%&<>@^~=+_\\", b"|", b"!", b"?", b".", b",;:", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b"()[]{}\"'", b"-/"]
_OF_BYTE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_CLASSES, 1):
    _OF_BYTE[list(_chars)] = _k
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OWN = len(_CLASSES) + 8
N_FEATURES = 1 + 3 * _OWN + 2
_HASH = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, size=256, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    step = lambda b: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64)
    return step(_BASE), step(pow(_BASE, -1, 1 << 64))


class _Hashes:
    """Hashes of stretches of bytes that count each byte by its place in the stretch."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(10, int(len(data)).bit_length())
        powers, self.back = _powers(size)
        self.total = np.concatenate(([np.uint64(0)], np.cumsum(_HASH[data] * powers[: len(data)], dtype=np.uint64)))

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return ((self.total[stops] - self.total[starts]) * self.back[starts]) * _MIX + (stops - starts).astype(np.uint64)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        upto = np.searchsorted(np.cumsum(sizes[at : at + _PART]), _PART_BYTES, side="right")
        yield batch.slice(at, max(1, int(upto)))
        at += max(1, int(upto))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums between the starts, the last of which is the end; empty stretches sum to 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether a key comes again anywhere."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    same = in_order[1:] == in_order[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of the texts, line lengths in bytes, and lines of each text.

    All texts are one byte array; classes are looked up and summed between line ends.
    """
    coded = [t.encode("utf-8") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends + 1))
    lines = np.array([c.count(b"\n") for c in coded], np.int64)
    length = np.diff(starts) - 1
    wide = np.maximum(length, 1)
    n = len(length)
    text_of_line = np.repeat(np.arange(len(texts)), lines)

    own = np.zeros((n, _OWN))
    line_of_byte = np.repeat(np.arange(n), length + 1)
    counts = np.bincount(line_of_byte * 16 + _OF_BYTE[data], minlength=16 * n).reshape(n, 16)
    own[:, : len(_CLASSES)] = counts[:, 1 : len(_CLASSES) + 1] / wide[:, None]

    space = _IS_SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    stops = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    line_of_word = line_of_byte[begins]
    words = np.bincount(line_of_word, minlength=n)
    some = np.maximum(words, 1)
    word_length = stops - begins
    hashes = _Hashes(data)
    word = hashes.of(begins, stops)
    text_of_word = text_of_line[line_of_word]

    k = len(_CLASSES)
    own[:, k] = np.log1p(length)
    own[:, k + 1] = np.bincount(line_of_word, weights=word_length, minlength=n) / some
    own[:, k + 2] = np.bincount(line_of_word, weights=(word_length > 20), minlength=n) / some
    again = np.zeros(len(word))
    if len(word) > 1:
        again[1:] = (word[1:] == word[:-1]) & (text_of_word[1:] == text_of_word[:-1])
    own[:, k + 3] = np.bincount(line_of_word, weights=again, minlength=n) / some
    grams = word.copy()
    for step in range(1, min(4, len(word))):
        grams[:-step] = grams[:-step] * np.uint64(3) + word[step:]
    within = np.zeros(len(word), bool)
    if len(word) > 3:
        within[:-3] = text_of_word[3:] == text_of_word[:-3]
    repeated = np.zeros(len(word))
    repeated[within] = _twice(grams[within] ^ (text_of_word[within].astype(np.uint64) * _MIX))
    own[:, k + 4] = np.bincount(line_of_word, weights=repeated, minlength=n) / some
    line_hash = hashes.of(starts[:-1], ends)
    own[:, k + 5] = _twice(line_hash ^ (text_of_line.astype(np.uint64) * _MIX)) & (words > 0)
    own[:, k + 6] = words == 0
    tail = data[np.maximum(ends - 1, 0)]
    own[:, k + 7] = (tail == 46) & (length > 0)

    first = np.concatenate(([0], np.cumsum(lines)[:-1]))
    last = np.cumsum(lines) - 1
    full = np.zeros((n, N_FEATURES))
    full[:, 0] = 1
    full[:, 1 : 1 + _OWN] = own
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    full[:, 1 + _OWN : 1 + 2 * _OWN] = before
    full[:, 1 + 2 * _OWN : 1 + 3 * _OWN] = after
    full[first, -2] = 1
    full[last, -1] = 1
    return full, length, lines


class Chains:
    """Forward-backward over texts side by side, the longest first, one step at a time."""

    def __init__(self, lines: np.ndarray):
        self.lines = lines
        self.order = np.argsort(-lines, kind="stable")
        self.first = (np.concatenate(([0], np.cumsum(lines)[:-1])))[self.order]
        long = lines[self.order]
        self.deepest = int(long[0]) if len(long) else 0
        self.alive = np.searchsorted(-long, -np.arange(self.deepest), side="left") if self.deepest else np.zeros(0, np.int64)

    def run(self, scores: np.ndarray, moves: np.ndarray, weights: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """P(good) of every line, expected moves (2 x 2), the log partition value of every text.

        scores are the lines' scores of good over bad; moves[a, b] is the score of state a
        being followed by b. Where weights makes a number for each text from the partition
        values, the moves so weighted come last.
        """
        up = np.exp(moves)
        emit = np.stack([np.ones_like(scores), np.exp(np.clip(scores, -30, 30))], axis=1)
        forward, scale = np.empty_like(emit), np.empty(len(scores))
        for t in range(self.deepest):
            at = self.first[: self.alive[t]] + t
            f = emit[at] if t == 0 else (forward[at - 1] @ up) * emit[at]
            scale[at] = s = f.sum(axis=1)
            forward[at] = f / s[:, None]
        logs = _sums(np.log(scale), np.concatenate(([0], np.cumsum(self.lines))))
        weight = None if weights is None else weights(logs)[self.order]
        backward = np.ones_like(emit)
        pairs, weighted = np.zeros((2, 2)), np.zeros((2, 2))
        for t in range(self.deepest - 1, 0, -1):
            n = self.alive[t]
            at = self.first[:n] + t
            ahead = backward[at] * emit[at] / scale[at][:, None]
            pairs += (forward[at - 1].T @ ahead) * up
            if weight is not None:
                weighted += ((forward[at - 1] * weight[:n, None]).T @ ahead) * up
            backward[at - 1] = ahead @ up.T
        good = forward * backward
        return good[:, 1] / good.sum(axis=1), pairs, logs, None if weight is None else weighted


def marginals(scores: np.ndarray, lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected moves (2 x 2), and the sum of log partition values."""
    good, pairs, logs, _ = Chains(lines).run(scores, moves)
    return good, pairs, float(logs.sum())


def given_labels(chains: Chains, scores: np.ndarray, moves: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line and expected moves, with the texts' labels known: all lines are good, or one is bad at least."""
    lines, bad = chains.lines, label == 0
    ends = np.concatenate(([0], np.cumsum(lines)))
    path = _sums(np.clip(scores, -30, 30), ends) + (lines - 1) * moves[1, 1]
    all_good = np.zeros(len(lines))

    def weights(logs: np.ndarray) -> np.ndarray:
        all_good[:] = np.minimum(np.exp(np.minimum(path - logs, 0)), 1 - 1e-9)
        return bad / (1 - all_good)

    good, _, _, seen = chains.run(scores, moves, weights)
    of_line = np.repeat(all_good, lines)
    told = np.where(np.repeat(bad, lines), np.clip((good - of_line) / (1 - of_line), 0, 1), 1.0)
    seen[1, 1] += ((lines - 1) * np.where(bad, -all_good / (1 - all_good), 1.0)).sum()
    return told, seen


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    def qualities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean P(good) of each text by line length, P(good) of every line, lines of each text."""
        x, length, lines = line_features(texts)
        good, _, _ = marginals(((x - self.mean) / self.spread) @ self.weights, lines, self.moves)
        ends = np.concatenate(([0], np.cumsum(lines)))
        weight = np.maximum(length, 1)
        return _sums(good * weight, ends) / _sums(weight, ends), good, lines

    def scores(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * _logit(quality), -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(x: np.ndarray, length: np.ndarray, lines: np.ndarray, label: np.ndarray, steps: int = 100, ridge: float = 1.0) -> Model:
    """The field's weights by gradient ascent (Adam) on the likelihood of the documents' labels, line labels being latent."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[spread < 1e-9] = 0.0, 1.0
    z = (x - mean) / spread
    y = np.repeat(label, lines).astype(float)
    chained = np.flatnonzero(np.repeat(np.arange(len(lines)), lines)[1:] == np.repeat(np.arange(len(lines)), lines)[:-1])
    alike = np.zeros((2, 2))
    np.add.at(alike, (y[chained].astype(int), y[chained + 1].astype(int)), 1)
    w = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    chains = Chains(lines)
    for k in range(1, steps + 1):
        scores, moves = z @ w[:-4], w[-4:].reshape(2, 2)
        good, pairs, _, _ = chains.run(scores, moves)
        told, seen = (y, alike) if k <= steps * WARM else given_labels(chains, scores + LENIENCE * (y == 0), moves, label)
        slope = np.concatenate((z.T @ (told - good), (seen - pairs).ravel())) / len(y) - ridge * w / len(y)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Model(mean, spread, w[:-4], w[-4:].reshape(2, 2))
    good, _, _ = marginals(z @ model.weights, lines, model.moves)
    ends, weight = np.concatenate(([0], np.cumsum(lines))), np.maximum(length, 1)
    quality = _sums(good * weight, ends) / _sums(weight, ends)
    model.curve = logistic(list(zip(_logit(quality), label, strict=True)))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> Model:
    """A model from at most about sample_rows labelled documents of at most about sample_lines lines."""
    taken = bounded_labels(labels, "quality", sample_rows, folds=FOLDS, held_out=HELD_OUT)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sample = docs.select("doc_id", text.alias("text")).join(F.broadcast(taken), "doc_id")
    n, lines = sample.agg(F.count("*"), F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()
    if not n:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.zeros((2, 2)))
    if lines > sample_lines:
        sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * sample_lines / lines))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                x, length, own = line_features(part.column(1).to_pylist())
                ends = np.concatenate(([0], np.cumsum(own)))
                rows = [(x[a:b].astype(np.float32).tobytes(), length[a:b].astype(np.int64).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["doc_id", "label", "x", "length"],
                )

    rows = sample.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(each, "doc_id long, label int, x binary, length binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    length = [np.frombuffer(bytes(r["length"]), np.int64) for r in rows]
    x = np.concatenate([np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES) for r in rows]).astype(float)
    return train(x, np.concatenate(length), np.array([len(a) for a in length]), np.array([r["label"] > 0 for r in rows], float))


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_lines, n_good_lines.

    n_good_lines counts lines that are likelier good than bad. A null text counts as an
    empty one, which is a single empty line and gets a score too. Repeated rows each get
    their row, null identifiers stay, further columns are ignored, an empty table gives
    no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                quality, good, lines = model.qualities([x or "" for x in part.column(1).to_pylist()])
                n_good = _sums((good > 0.5).astype(np.int64), np.concatenate(([0], np.cumsum(lines))))
                columns = [part.column(0), part.column(2), pa.array(model.scores(quality)), pa.array(lines, pa.int64()), pa.array(n_good, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "n_lines", "n_good_lines"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    out = source.mapInArrow(each, "doc_id long, held_out boolean, score double, n_lines long, n_good_lines long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_lines", "n_good_lines")


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return apply(docs, fit(docs, labels, sample_rows))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, with all their columns.

    A null text scores as an empty one. Repeated rows and rows without an identifier are
    judged each by itself; an empty table stays empty.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index("text")
            for part in _parts(batch, column):
                text = part.column(column).to_pylist()
                quality, _, _ = model.qualities([x or "" for x in text])
                yield part.filter(pa.array(model.scores(quality) >= THRESHOLD))

    return docs.mapInArrow(each, docs.schema)
