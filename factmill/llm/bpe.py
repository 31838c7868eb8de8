"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation.

A word's symbols form a doubly linked list. Adjacent pairs that can merge wait in a heap
by rank, then place; an entry whose symbols have changed since is stale and skipped.
Encoded words are kept in a cache of bounded size, per Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level BPE cuts a text into words (a fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000
_SPACES_MEET = re.compile(r"\s\s")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """word -> its ids as little-endian 32-bit; starts anew when it is full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.encode(word)
        return found


class Codec:
    """The vocabulary and merges of a tokenizers file of the byte-level BPE kind."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec.get("added_tokens") or []
        steps = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("this codec reads byte-level BPE files without normalizer or prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens that strip, normalize or ask for word ends are not supported")
        vocab, symbols = model["vocab"], byte_symbols()
        self.of_byte = [vocab[s] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = [b""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for token, i in vocab.items():
            if all(c in byte_of for c in token):
                self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        for t in added:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.digits_of = [str(i) for i in range(len(self.bytes_of))]
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.find_words = regex.compile(WORDS).findall
        self.words = _Cache(lambda w: np.array(self.merge(w.encode("utf-8")), "<u4").tobytes(), cache_words)
        self.chunks = _Cache(self._chunk, cache_words)
        self.spaced = _Cache(lambda c: self._chunk(c if c[:1] == "\n" else " " + c), cache_words)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.of_byte[b] for b in word]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find_words(chunk)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text in which added tokens' strings don't occur.

        A lone space or newline between other characters always begins a word, so there
        a text can be cut before it is matched; where white space meets, it isn't.
        """
        if _SPACES_MEET.search(text):
            return self._chunk(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.chunks[first] + b"".join(map(self.spaced.__getitem__, rest))

    def encode(self, text: str) -> np.ndarray:
        if self.cut_added is None or not any(t in text for t in self.added):
            return np.frombuffer(self._plain(text), "<u4")
        parts = (self.added.get(p) or self._plain(p) for p in self.cut_added.split(text))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids) -> str:
        """Vocabulary strings joined; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """One for each Python worker, kept over its tasks."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every whole text (null: empty), in the rows' own partitions.

    Repeated rows each get their row, null identifiers stay, other columns are ignored,
    an empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([own.encode(x or "").astype(np.int32) for x in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(each, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """id, text: the strings of the ids joined (null: empty)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = pa.array([own.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col)).mapInArrow(each, "id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes every whole text in one pass."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path), hashlib.sha256
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "").tolist()
                n.append(len(ids))
                of_ids.append(sha(",".join(map(own.digits_of.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha(own.decode(ids).encode("utf-8")).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return source.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
