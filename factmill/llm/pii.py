"""Personal data by weak supervision.

Patterns propose spans: the base kinds (email, ip, card, phone), their matches that fail
a check, and looser ones (spelled-out addresses, bare phone numbers, secrets). Labelers
(shape, gazetteer, context, boundary, checksum, surroundings) each vote for, against or
not at all. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, without labels; the counts cover every span of every document,
and vote patterns are a small fixed set, so what reaches the driver is bounded.

Its posteriors are the soft labels on which the final classifier of spans is trained. The
classifier doesn't see the votes: it sees the span's kind, its characters (classes,
entropy, runs, letters that read like words, check digits) and the word that follows, while labelers
look at the words before. So it carries what the labelers found over to spans on which they are silent or
wrong, and may decide differently on two spans with the same votes.

Base spans that pass their checks always stay; the classifier decides the others.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "card_inner", "email_spelled", "phone_bare", "secret")
N_LABELERS = 6
#: Most spans that the final classifier is trained on; they are chosen by a hash of place and text.
SAMPLE_SPANS = 20_000
#: Words before a span in which the context labeler looks, and buckets of the word behind it.
CONTEXT_WORDS = 5
BUCKETS = 32
N_SHAPE = 12
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: then it would start at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CARD_INNER = re.compile(r"(?<![0-9])[0-9]{16,19}(?![0-9])")
_BARE = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
# The lengths are those that mail allows for a name and the domain system for a label.
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\bat\b|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\bdot\b|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63})+", re.I)
_SECRET = re.compile(r"(?<![0-9A-Za-z_-])[0-9A-Za-z_-]{12,}(?![0-9A-Za-z_-])")
_NUMBER_NEAR = re.compile(r"[0-9]")

# Words that the gazetteer and context labelers know.
GAZETTEER = {
    "email": {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "co", "us"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "auth", "bearer", "credential"},
    "phone": {"1", "33", "34", "44", "49", "39", "41", "43", "31", "32", "7", "81", "86", "91", "52", "54", "55"},
    "card": {"4", "51", "52", "53", "54", "55", "34", "37", "60", "65", "35", "36", "30", "22", "23", "24", "25", "26", "27"},
}
CONTEXT = {
    "email": {"mail", "email", "e-mail", "contact", "write", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "server", "address", "addr", "login", "from"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell", "telefon", "telephone"},
    "secret": {"password", "passwd", "pwd", "secret", "token", "key", "login", "auth", "bearer"},
}
_FAMILY = {"card_inner": "card", "email_spelled": "email", "phone_bare": "phone"}
_BEFORE = re.compile(r"[A-Za-z_-]+")


class _Words:
    """The words of a text, found once and only if they are asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def places(self) -> tuple[list[int], list[int]]:
        found = [(m.start(), m.end()) for m in _BEFORE.finditer(self.text)]
        return [a for a, _ in found], [b for _, b in found]

    def before(self, start: int, n: int) -> list[str]:
        """The last n words that end at start or before."""
        starts, ends = self.places
        upto = bisect_right(ends, start)
        return [self.text[starts[k] : ends[k]].lower().strip("-_") for k in range(max(0, upto - n), upto)]

    def after(self, end: int) -> str:
        starts, ends = self.places
        k = bisect_left(starts, end)
        return self.text[starts[k] : ends[k]].lower().strip("-_") if k < len(starts) else ""


def _bucket(word: str) -> int:
    """A word's bucket; 0 for none."""
    return 1 + zlib.crc32(word.encode("utf-8")) % (BUCKETS - 1) if word else 0


def _well_formed(kind: str, s: str) -> bool:
    """Whether a span is what its kind's numbering allows: check digits, octets, numbers of digits."""
    digits, family = _digits(s), _FAMILY.get(kind, kind)
    if family == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if family == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    return family != "phone" or 8 <= len(digits) <= 15


def features(text: str, words: _Words, kind: str, start: int, end: int) -> list[float]:
    """What the classifier sees of a span beside its kind: N_SHAPE numbers and the bucket of the next word."""
    s = text[start:end]
    n = len(s)
    counts = Counter(s)
    classes = "".join("d" if "0" <= c <= "9" else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in s)
    letters = classes.count("u") + classes.count("l")
    shape = [
        math.log1p(n),
        classes.count("d") / n, classes.count("u") / n, classes.count("l") / n, classes.count("o") / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()) / 5,
        len(counts) / n,
        sum(a != b for a, b in zip(classes, classes[1:])) / n,
        sum(k for c, k in counts.items() if c in "aeiouAEIOU") / letters if letters else 0.0,
        max((len(r) for r in re.findall("[ul]+", classes)), default=0) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(_well_formed(kind, s)),
    ]
    return [*shape, float(_bucket(words.after(end)))]


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that the scan is linear."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    doubled = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits)))
    return doubled % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes its check) of the base patterns, by kind and start."""
    found = [("email", a, b, True) for a, b in _emails(text)]
    if _NUMBER_NEAR.search(text):
        for m in _IP.finditer(text):
            found.append(("ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))))
        for m in _CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() >= 16 else ""
            found.append(("card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)))
        if "+" in text:
            for m in _PHONE.finditer(text):
                found.append(("phone", m.start(), m.end(), 8 <= len(_digits(m.group())) <= 15))
    return found


def _candidates(text: str, base: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, bool | None]]:
    """Base matches worth a vote, and looser spans that touch no base span that passes."""
    out: list = [m for m in base if m[3] or m[0] in ("ip", "phone") or m[2] - m[1] >= 13]
    taken = sorted((a, b) for _, a, b, ok in base if ok)
    loose = []
    lower = text.lower() if "dot" in text or "Dot" in text or "DOT" in text else ""
    if "dot" in lower:
        loose += [("email_spelled", m.start(), m.end()) for m in _SPELLED.finditer(text)]
    for kind, a, b, ok in base:
        if kind == "card" and not ok and b - a > 16:
            loose += [("card_inner", m.start(), m.end()) for m in _CARD_INNER.finditer(text, a, b) if luhn(m.group())]
    if _NUMBER_NEAR.search(text):
        loose += [("phone_bare", m.start(), m.end()) for m in _BARE.finditer(text)]
        for m in _SECRET.finditer(text):
            s = m.group()
            if _NUMBER_NEAR.search(s) and any(c.isalpha() for c in s):
                loose.append(("secret", m.start(), m.end()))
    at = 0
    for kind, a, b in sorted(loose, key=lambda x: x[1]):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            out.append((kind, a, b, None))
    return out


def votes(text: str, words: _Words, kind: str, start: int, end: int, passes: bool | None) -> int:
    """The vote pattern of a span: a base-3 number of the labelers' votes, plus its kind's block."""
    family, s = _FAMILY.get(kind, kind), text[start:end]
    digits = _digits(s)
    before = words.before(start, CONTEXT_WORDS)
    left, right = text[start - 1 : start] if start else " ", text[end : end + 1] or " "
    shape = 0 if passes is None else 1 if passes else -1
    if family == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", s)[-1].lower() in GAZETTEER["email"] else -1
        checksum = 1 if any(c.isalpha() for c in s.split("@")[0]) else -1
    elif family == "secret":
        gazetteer = 1 if before and before[-1] in GAZETTEER["secret"] else -1
        checksum = 1 if 0.15 <= len(digits) / len(s) <= 0.85 and len(s) >= 16 else -1
    elif family == "phone":
        gazetteer = 0 if kind == "phone_bare" else 1 if any(digits.startswith(c) for c in GAZETTEER["phone"]) else -1
        checksum = 1 if 10 <= len(digits) <= 13 else -1
    elif family == "card":
        gazetteer = 1 if any(digits.startswith(c) for c in GAZETTEER["card"]) else -1
        checksum = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
    else:
        gazetteer = 0
        checksum = 1 if all(p == "0" or not p.startswith("0") for p in s.split(".")) else -1
    context = 1 if any(w in CONTEXT[family] for w in before) else 0
    boundary = -1 if left.isalnum() or right.isalnum() else 1
    around = -1 if left in "#%$&*/.vV" or right in "#%$&*/%" else 0
    pattern = 0
    for v in (shape, gazetteer, context, boundary, checksum, around):
        pattern = pattern * 3 + v + 1
    return KINDS.index(kind) * 3**N_LABELERS + pattern


def _unpack(pattern: int) -> tuple[int, list[int]]:
    kind, rest = divmod(pattern, 3**N_LABELERS)
    out = []
    for _ in range(N_LABELERS):
        rest, v = divmod(rest, 3)
        out.append(v)
    return kind, out[::-1]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.int32()), ("x", pa.list_(pa.float64()))]))
_SPAN_SQL = "array<struct<kind:string,start:long,end:long,pattern:int,x:array<double>>>"


def _spans_of(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans that pass, and all other candidates."""
    if "@" not in text and not _NUMBER_NEAR.search(text) and "dot" not in text.lower():
        return [], []
    base, other, words = [], [], _Words(text)
    for kind, a, b, passes in _candidates(text, matches(text)):
        span = {"kind": kind, "start": a, "end": b, "pattern": votes(text, words, kind, a, b, passes), "x": features(text, words, kind, a, b)}
        (base if passes else other).append(span)
    return base, other


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base, other: the spans of every row's whole text (null: empty)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [_spans_of(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in both], _SPAN), pa.array([o for _, o in both], _SPAN)], names=["doc_id", "base", "other"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(each, f"doc_id long, base {_SPAN_SQL}, other {_SPAN_SQL}")


def pattern_counts(found: DataFrame) -> dict[int, int]:
    """How often each vote pattern occurs, over all documents; at most 8 x 3^6 entries."""
    each = found.select(F.explode(F.concat(F.col("base.pattern"), F.col("other.pattern"))).alias("pattern"))
    return {r["pattern"]: r["n"] for r in each.groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """EM: each pattern's posterior of being personal data, and P(vote | class) by labeler (class, labeler, vote).

    Votes are independent given the class, and one not cast says nothing; the share of true
    spans differs by kind. It starts from the majority of votes.
    """
    if not counts:
        return {}, np.full((2, N_LABELERS, 3), 1 / 3)
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    kinds = np.array([_unpack(p)[0] for p in patterns])
    ballots = np.array([_unpack(p)[1] for p in patterns])
    true = 1 / (1 + np.exp(-2.0 * (ballots - 1).sum(axis=1)))
    for _ in range(rounds):
        rates = np.empty((2, N_LABELERS, 3))
        for c, share in enumerate((1 - true, true)):
            for j in range(N_LABELERS):
                seen = np.bincount(ballots[:, j], weights=n * share, minlength=3) + 1.0
                seen[1] = 0
                rates[c, j] = seen / seen.sum()
        prior = (np.bincount(kinds, weights=n * true, minlength=len(KINDS)) + 1) / (np.bincount(kinds, weights=n, minlength=len(KINDS)) + 2)
        score = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for j in range(N_LABELERS):
            cast = ballots[:, j] != 1
            score[cast] += np.log(rates[1, j, ballots[cast, j]]) - np.log(rates[0, j, ballots[cast, j]])
        true = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(patterns, true.tolist(), strict=True)), rates


def _expanded(kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The classifier's columns: kind, each kind's own numbers, and the bucket of the next word."""
    n, k = len(kinds), len(KINDS)
    out = np.zeros((n, k + k * N_SHAPE + BUCKETS))
    at = np.arange(n)
    out[at, kinds] = 1
    for j in range(N_SHAPE):
        out[at, k + kinds * N_SHAPE + j] = x[:, j]
    out[at, k + k * N_SHAPE + x[:, N_SHAPE].astype(int)] = 1
    return out


@dataclass
class Classifier:
    weights: np.ndarray

    def probability(self, kinds: list[str], x: list[list[float]]) -> np.ndarray:
        if not kinds:
            return np.zeros(0)
        z = _expanded(np.array([KINDS.index(c) for c in kinds]), np.array(x, float))
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


def train(kinds: list[str], x: list[list[float]], label: list[float], ridge: float = 0.1, rounds: int = 15) -> Classifier:
    """A logistic model of spans on soft labels, by Newton steps."""
    width = len(KINDS) * (1 + N_SHAPE) + BUCKETS
    if not kinds:
        return Classifier(np.zeros(width))
    z, y, w = _expanded(np.array([KINDS.index(c) for c in kinds]), np.array(x, float)), np.array(label), np.zeros(width)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge * np.eye(width), z.T @ (y - q) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return Classifier(w)


def fit(found: DataFrame, sample_spans: int = SAMPLE_SPANS) -> Classifier:
    """The classifier of candidates(): posteriors from the votes of all spans, trained on about sample_spans of them."""
    counts = pattern_counts(found)
    posterior, _ = reliabilities(counts)
    n = sum(counts.values())
    each = found.select("doc_id", F.explode(F.concat("base", "other")).alias("s")).select("s.*", F.xxhash64("doc_id", "s.start", "s.kind").alias("at"))
    if n > sample_spans:
        each = each.where(F.pmod("at", F.lit(1_000_000)) < int(1_000_000 * sample_spans / n))
    rows = sorted(each.select("kind", "x", "pattern", "at").collect(), key=lambda r: (r["at"], r["pattern"], r["x"]))
    return train([r["kind"] for r in rows], [r["x"] for r in rows], [posterior[r["pattern"]] for r in rows])


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, base and added, arrays of (kind, start, end) in code points.

    base is ordered by kind (email, ip, card, phone) and start; added by start and kind. A
    span whose probability equals the threshold is added. Null or empty texts have no
    spans. Repeated rows each get their row, null identifiers stay, further columns are
    ignored, an empty table gives no rows.
    """
    found = cut(candidates(docs))
    model = fit(found)
    plain = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            accepted = iter(model.probability([s["kind"] for r in rows for s in r], [s["x"] for r in rows for s in r]) >= threshold)
            added = [sorted(({k: s[k] for k in ("kind", "start", "end")} for s in r if next(accepted)), key=lambda s: (s["start"], s["kind"])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, plain)], names=["doc_id", "base", "added"])

    kept = "array<struct<kind:string,start:long,end:long>>"
    bare = F.transform("base", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).alias("base")
    decided = found.where("size(other) > 0").select("doc_id", bare, "other").mapInArrow(each, f"doc_id long, base {kept}, added {kept}")
    return decided.union(found.where("size(other) = 0").select("doc_id", bare, F.array().cast(kept)))


def _joined(spans_col: str):
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans (base then added kinds), n_added."""
    found = spans(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.transform(
        F.sort_array(
            F.transform(
                F.concat("base", "added"),
                lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return found.withColumn("every", ordered).select(
        "doc_id", *map(count, BASE), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("every").alias("spans"), F.size("added").cast("long").alias("n_added")
    )


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every span replaced by its kind in brackets, and n_chars counted anew.

    Votes are counted over all of docs; the spans are then found again beside the texts,
    which therefore are never shuffled. Overlapping spans become one, named by the first.
    Null texts stay null; repeated rows and rows without an identifier all stay; an
    empty table stays empty.
    """
    model = fit(cut(candidates(docs)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else _redacted(t, model, threshold) for t in (x.as_py() for x in batch.column(at))]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if (k := batch.schema.get_field_index("n_chars")) >= 0:
                sizes = [n if t is None else len(t) for t, n in zip(texts, columns[k].to_pylist(), strict=True)]
                columns[k] = pa.array(sizes, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(each, docs.schema)


def _redacted(text: str, model: Classifier, threshold: float) -> str:
    base, other = _spans_of(text)
    accepted = model.probability([s["kind"] for s in other], [s["x"] for s in other]) >= threshold
    chosen = sorted((s["start"], s["end"], s["kind"]) for s in [*base, *(s for s, yes in zip(other, accepted, strict=True) if yes)])
    if not chosen:
        return text
    out, at = [], 0
    for start, end, kind in chosen:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
