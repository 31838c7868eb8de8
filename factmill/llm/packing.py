"""Order-preserving packing of documents into token windows by dynamic programming.

The token stream keeps the documents' order. Windows may be cut at the ends of documents
(free) or sentences (a small penalty), and within a sentence at a larger one. A window of a power of two needs no padding, any other is padded to the full
size. With f(j) the least cost of the stream up to cut j,

    f(j) = penalty(j) + min over i within reach of f(i) + size - (pos(j) - pos(i)),

whose minimum over the reach is that of f(i) + pos(i): a monotone queue yields it in
constant time per cut; windows of a power of two are looked up by place. Steps of two
windows have a queue of their own.

Each task packs its own rows as they stream in, a block of tokens at a time, carrying the
unfinished window over to the next block. Texts are never shuffled, and what a task holds
is a block and one document.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
BLOCK = 1 << 19
SENTENCE_PENALTY = 1.0
WORD_PENALTY = 4.0
#: Shorter windows are never made on purpose, though a power of two needs no padding.
LEAST_WINDOW = 256
CACHE_CHUNKS = 800_000
#: What cached words may take, by an estimate: of an entry's bytes these are taken besides the word and its ids.
CACHE_BYTES = 48 << 20
_ENTRY_BYTES = 160


class Tokens:
    """Ids of texts by a tokenizers file.

    Files that lower-case, drop white space and split letters, digits and marks apart may be
    given words one by one, so those are cached; with any other file whole texts are encoded.
    The cache starts anew once it holds cache_chunks words or about cache_bytes.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {"": b""}
        self.most, self.most_bytes, self.held_bytes = cache_chunks, cache_bytes, 0
        self.by_word = _splits_words(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_sentence = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word = self.ends_sentence.copy()
        for token, i in vocab.items():
            body = token.removesuffix("</w>")
            self.ends_word[i] = token != body
            self.ends_sentence[i] = bool(body) and (token != body or not self.by_word) and set(body) <= set(".!?")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit; words not met before are encoded together."""
        if not self.by_word:
            return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.cache) >= self.most or self.held_bytes >= self.most_bytes:
            self.cache, self.held_bytes = {"": b""}, 0
        cache = self.cache
        chunks = [_apart(t).replace("\n", " ").split(" ") for t in texts]
        coded = [list(map(cache.get, own)) for own in chunks]
        gaps = [[i for i, v in enumerate(have) if v is None] for have in coded]
        new = list({own[i] for own, at in zip(chunks, gaps, strict=True) for i in at})
        self._learn(new)
        self.held_bytes += sum(_ENTRY_BYTES + len(w) + len(cache[w]) for w in new)
        for own, have, at in zip(chunks, coded, gaps, strict=True):
            for i in at:
                have[i] = cache[own[i]]
        return list(map(b"".join, coded))

    def _learn(self, new: list[str]) -> None:
        """Words of letters alone are encoded as one text, in which every word's last id shows its end."""
        letters = [w for w in new if w.isalpha()]
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                coded, ends = ids.tobytes(), (4 * ends).tolist()
                self.cache.update(zip(part, map(coded.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
            else:
                self._learn_alone(part)
        self._learn_alone([w for w in new if not w.isalpha()])

    def _learn_alone(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for word, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.cache[word] = np.array(coded.ids, "<u4").tobytes()


# What a tokenizers file must say for its words to be independent of each other (fixed values of the format).
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_words(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal, cut, model = (spec.get("normalizer") or {}), (spec.get("pre_tokenizer") or {}), spec["model"]
    steps = cut.get("pretokenizers") or [{}]
    first = steps[0]
    return (
        normal.get("normalizers") == _NORMAL
        and first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space")
        and model.get("end_of_word_suffix") == "</w>" and model.get("type") == "BPE" and not model.get("dropout")
        and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in spec.get("added_tokens") or [])
    )


_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: Latin-1 characters: 1 points and commas, 2 others that are neither letters, digits nor space.
_KIND = np.array([1 if c in ".," else 0 if c.isalnum() or c in _SPACE else 2 for c in map(chr, range(256))], np.uint8)


def _apart(text: str) -> str:
    """An equal text for the tokenizer, with fewer different words: lower case, points and commas set apart.

    Both hold for Latin-1, which has no combining marks, and the second where points and
    commas touch only letters, digits and space; elsewhere the text stays as it is. Texts
    with added tokens, which are looked for as they stand, hold "<" and "|" and keep case.
    """
    try:
        kind = _KIND[np.frombuffer(text.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        return text
    if "<|" in text:
        return text
    text = text.lower()
    marks = kind == 1
    if (marks[1:] & (kind[:-1] > 0)).any() or (marks[:-1] & (kind[1:] > 0)).any():
        return text
    return text.replace(",", " ,").replace(".", " .")


@lru_cache(2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def best_cuts(pos: list[int], penalty: list[float], window: int = WINDOW, least: int = LEAST_WINDOW) -> tuple[list[float], list[tuple[int, int]]]:
    """f, and (previous cut's index, windows since), for cuts at pos (ascending from 0, steps of at most window).

    A step of two windows cuts the first at its full size, within a sentence, at
    WORD_PENALTY. The queues hold the cuts up to one window back, and up to two.
    """
    exact: dict[int, list[int]] = {}
    places = np.array(pos)
    for size in (1 << k for k in range(window.bit_length()) if least <= 1 << k < window):
        i = np.minimum(np.searchsorted(places, places - size), len(pos) - 1)
        for j in np.flatnonzero(places[i] == places - size).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    f, back, key = [0.0], [(-1, 0)], [float(pos[0])]
    one, two, ahead = deque([0]), deque(), 0
    for j in range(1, len(pos)):
        p = pos[j]
        near = p - window
        while pos[one[0]] < near:
            one.popleft()
        at, windows = one[0], 1
        cost = key[at] + window - p
        while pos[ahead] < near:
            new = key[ahead]
            while two and key[two[-1]] >= new:
                two.pop()
            two.append(ahead)
            ahead += 1
        while two and pos[two[0]] < near - window:
            two.popleft()
        if two and key[two[0]] + WORD_PENALTY + 2 * window - p < cost:
            at, windows = two[0], 2
            cost = key[at] + WORD_PENALTY + 2 * window - p
        if j in exact:
            for i in exact[j]:
                if f[i] < cost:
                    cost, at, windows = f[i], i, 1
        cost += penalty[j]
        f.append(cost)
        back.append((at, windows))
        new = cost + p
        key.append(new)
        while one and key[one[-1]] >= new:
            one.pop()
        one.append(j)
    return f, back


class Packer:
    """Takes documents in order, yields (doc_id, start, length, doc_tokens, sequence, offset, ids)."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int, window: int = WINDOW, block: int = BLOCK):
        self.ends_sentence, self.window, self.block = ends_sentence, window, block
        self.sequence = first_sequence
        self.parts: list[np.ndarray] = []
        self.segments: list[list[int | None]] = []  # doc_id, start in the document, length, doc_tokens
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append(ids)
        self.segments.append([doc_id, 0, len(ids), len(ids)])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(final=False)

    def flush(self, final: bool = True) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.concatenate(self.parts)
        ends = np.cumsum([s[2] for s in self.segments])
        cost = np.full(len(ids) + 1, np.inf)
        cost[np.flatnonzero(self.ends_sentence[ids]) + 1] = SENTENCE_PENALTY
        cost[ends] = cost[0] = 0.0
        regular = np.flatnonzero(cost < np.inf)
        for k in np.flatnonzero(np.diff(regular) > self.window):
            cost[regular[k] + self.window : regular[k + 1] : self.window] = WORD_PENALTY
        places = np.flatnonzero(cost < np.inf)
        pos = places.tolist()
        f, back = best_cuts(pos, cost[places].tolist(), self.window)
        last = len(pos) - 1
        if not final:
            open_from = pos[last] - self.window
            last = min((j for j in range(len(pos) - 1, 0, -1) if pos[j] > open_from), key=lambda j: f[j])
        cuts, j = [pos[last]], last
        while back[j][0] >= 0:
            i, windows = back[j]
            cuts.extend(pos[i] + k * self.window for k in range(windows - 1, -1, -1))
            j = i
        cuts.reverse()
        at = 0
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            here = low
            while here < high:
                doc_id, start, length, doc_tokens = self.segments[at]
                begin = int(ends[at]) - length
                stop = min(high, int(ends[at]))
                if stop > here:
                    yield doc_id, start + here - begin, stop - here, doc_tokens, self.sequence, here - low, ids[here:stop]
                if stop == ends[at]:
                    at += 1
                here = stop
            self.sequence += 1
        done = pos[last]
        rest = [[d, s + max(0, done - (int(e) - n)), min(n, int(e) - done), t] for (d, s, n, t), e in zip(self.segments[at:], ends[at:], strict=True)]
        self.segments, self.parts, self.held = rest, [ids[done:]], len(ids) - done


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is its text's ids, then end_id; a null text is an empty one, and so a
    single token. Pieces of a sequence are gapless from offset 0. Repeated rows and rows
    without an identifier are packed like any other; further columns are ignored; an
    empty table gives no rows. Sequence numbers hold the task's number in their upper
    bits, so tasks number theirs without regard to others, and a task run again gives the
    same rows.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        longs = lambda k: pa.array([r[k] for r in rows], pa.int64())
        crc = pa.array([zlib.crc32(r[6].tobytes()) for r in rows], pa.int64())
        columns = [longs(0), longs(1), longs(2), crc, longs(3), longs(4), longs(5)]
        if with_ids:
            columns.append(pa.array([r[6].astype(np.int32) for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        packer = Packer(own.ends_sentence, TaskContext.get().partitionId() << 33, window)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                coded = own.encode_all([x or "" for x in part.column(1).to_pylist()])
                for doc_id, ids in zip(part.column(0).to_pylist(), coded, strict=True):
                    rows.extend(packer.add(doc_id, np.frombuffer(ids + end, "<u4")))
                if rows:
                    yield table(rows)
        if rows := list(packer.flush()):
            yield table(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, schema)
