"""SimHash near-duplicates by an inverted index over the bytes of a fingerprint.

Two 64-bit fingerprints that differ in at most r bits differ in at most r of their eight
bytes, so 8 - r positional bytes at least are shared: that is the guaranteed count. A list
under a single positional byte holds 1/256 of the corpus, and tallying pairs in such lists
is quadratic. The index therefore posts a fingerprint under each set of 8 - r positions
with its bytes there: a pair meets in such a list if and only if its tally of shared bytes
reaches the guaranteed count, so the count filter is the index itself. A pair that shares
s bytes is met in as many lists as s bytes have sets of 8 - r, which gives its tally back.
Pairs that meet are verified by their differing bits.

A list can't hold more than 256^r distinct fingerprints (65,536 for two bits), however
many documents there are, since equal fingerprints are one before they are posted. Before
that, a cheaper index drops what meets nobody: of r + 2 equal stretches of bits a pair
shares two at least, so a fingerprint that is alone under each pair of stretches is done.

Sixty-four bits can't tell a Jaccard similarity of 0.8: texts so similar differ in two to
eleven bits, mostly about six. keep_one, which drops near copies, therefore uses the same
index over longer signatures: 120 bytes, each that of the least shingle under a hash of
its own, so that two texts share a byte as often as their shingle sets are similar. They
are posted under 24 sets of five positions, candidates are kept if their tally of shared
bytes reaches 76, and verified on the whole sets of shingles. A pair of similarity 0.8
meets in no list with a probability of 7 in 100,000, and falls short of 76 bytes (it shares
96 on average) with one of about 1 in 100,000; more similar pairs hardly ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Near copies: words to a shingle and the similarity (a fraction); bytes of a signature, bytes to
#: a list's key, and the bytes that a candidate shares at least.
COPY_SHINGLE = 5
SIMILARITY = (4, 5)
POSITIONS, BAND = 120, 5
LEAST_SHARED = 76
#: Lists of more members get ROUNDS pivots before all their pairs are tallied, others one; a task
#: tallies chunks of so many members.
SHORT, ROUNDS = 8, 2
LIST_CHUNK = 2048
#: Rows that are sent to all tasks at most, where a join would else deal out texts.
BROADCAST = 200_000
_RANDOM = np.random.Generator(np.random.PCG64(9))
_FACTORS = _RANDOM.integers(0, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 64, POSITIONS, np.uint64)
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 where it has no words or is null."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _STEP):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])], dtype=">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp holds the fingerprint's bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(each, "id long, fp long")


def _keys(fp: Column, pieces: list[tuple[int, int]], most: int) -> Column:
    """All choices of `most` pieces (low bit, width) of a fingerprint, each packed into one long with its choice's number."""
    keys = []
    for k, chosen in enumerate(combinations(pieces, most)):
        key, at = F.lit(k).cast("long"), 0
        key = F.shiftleft(key, sum(w for _, w in chosen))
        for low, width in chosen:
            piece = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
            key, at = key.bitwiseOR(F.shiftleft(piece, at)), at + width
        keys.append(key)
    return F.array(*keys)


def _meeting(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp): fingerprints that share two of max_bits + 2 stretches of bits with another one."""
    ends = [64 * k // (max_bits + 2) for k in range(max_bits + 3)]
    stretches = [(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    posted = fps.select("fp", F.explode(_keys(F.col("fp"), stretches, 2)).alias("key"))
    crowded = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return posted.join(crowded, "key", "left_semi").select("fp").distinct()


def links(distinct_fp: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b, shared, bits): every pair of fingerprints within max_bits (1 to 3) of each other, a < b.

    shared is its tally of positional bytes, bits its differing bits.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("the index guarantees shared bytes for 1 to 3 differing bits")
    guaranteed = 8 - max_bits
    fps = cut(_meeting(distinct_fp.select("fp"), max_bits))
    posted = fps.select("fp", F.explode(_keys(F.col("fp"), [(8 * k, 8) for k in range(8)], guaranteed)).alias("key"))
    # at most 256^max_bits distinct fingerprints to a list
    lists = posted.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where("size(fps) > 1").select("fps")
    partners = F.transform(
        "fps",
        lambda a, i: F.struct(a.alias("a"), F.filter(F.slice("fps", i + 2, F.size("fps")), lambda b: F.bit_count(a.bitwiseXOR(b)) <= max_bits).alias("b")),
    )
    near = lists.select(F.explode(partners).alias("x")).select(F.col("x.a").alias("a"), F.explode("x.b").alias("b"))
    # a pair with one byte more than guaranteed is met in guaranteed + 1 lists, and so on
    tallies = F.create_map(*[F.lit(x) for t in range(guaranteed, 8) for x in (comb(t, guaranteed), t)])
    met = near.groupBy("a", "b").agg(F.count("*").cast("int").alias("lists"))
    return met.select("a", "b", tallies[F.col("lists")].alias("shared"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id, fp (signed long), fingerprint (hex), component_id.

    component_id is the smallest identifier among all rows reachable over links of at
    most max_bits differing bits, equal fingerprints included. Null or empty texts and
    texts without words have fingerprint zero and link like any other. Rows without an
    identifier get the component of their fingerprint (null where no row of it has one);
    repeated rows each get their row. An empty table gives no rows, and further columns
    of docs are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least_id")))
    component = connected_components(links(distinct, max_bits)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = distinct.join(component, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# copies by the Jaccard similarity of word shingles


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; one of all words if there are fewer, none without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))
    return np.unique(found)


def key_of(found: np.ndarray) -> int:
    """One number for a set of shingles; 0 for none."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def signature(found: np.ndarray) -> np.ndarray:
    """POSITIONS bytes, each that of the least of the shingles under a hash of its own; two sets share a byte as often as they are similar."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    return ((least * _FACTORS[0]) >> np.uint64(56)).astype(np.uint8)


def _with_shingles(texts: DataFrame, columns: dict[str, str], values, shingle: int) -> DataFrame:
    """id, text_hash and the columns that values(set) gives for each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [values(shingles(x.as_py(), shingle)) for x in batch.column(2)]
                made = [pa.array(list(v), kinds[t]) for v, t in zip(zip(*rows, strict=True), columns.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "text_hash", *columns])

    return texts.mapInArrow(each, ", ".join(["id long", "text_hash long", *(f"{c} {t}" for c, t in columns.items())]))


def _among(df: DataFrame, few: DataFrame, on, how: str) -> DataFrame:
    """df joined to rows that are seldom many: sent to all tasks up to BROADCAST rows, dealt out beyond that."""
    return df.join(F.broadcast(few) if few.count() <= BROADCAST else few, on, how)


class _Similar:
    """Links between sets of shingles, found by the byte index over their signatures."""

    def __init__(self, texts: DataFrame, prints: DataFrame, shingle: int, similarity: tuple[int, int], short: int, rounds: int):
        self.texts, self.shingle, self.short, self.rounds = texts, shingle, short, rounds
        self.of, self.outof = similarity
        self.nodes = cut(prints.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("text_hash").alias("text_hash")))

    def lists(self) -> DataFrame:
        """h, key, reach: the lists with two members or more; reach counts the members of all of a node's lists."""
        bytes_ = [F.substring("sig", 1 + BAND * b, BAND) for b in range(POSITIONS // BAND)]
        keys = F.array(*[F.conv(F.hex(x), 16, 10).cast("long") + (b << 8 * BAND) for b, x in enumerate(bytes_)])
        posted = self.nodes.select("key", F.explode(keys).alias("h"))
        sizes = posted.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
        met = cut(posted.join(sizes, "h"))
        reach = met.groupBy("key").agg(F.sum("size").alias("reach"))
        return cut(met.join(reach, "key").select("h", "key", "reach", "size"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose sets are similar: first by the tally of shared bytes, then by the sets themselves."""
        own = lambda side: self.nodes.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        both = pairs.join(own("a"), "a").join(own("b"), "b")
        sized = both.where(f"{self.outof} * least(n_a, n_b) >= {self.of} * greatest(n_a, n_b)")

        def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_SHARED))

        likely = cut(sized.select("a", "b", "sig_a", "sig_b").mapInArrow(tallied, "a long, b long"))
        sets = self.sets(likely.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        both = likely.join(sets.select(F.col("key").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("found").alias("y")), "b")
        same = F.size(F.array_intersect("x", "y"))
        return cut(both.where((self.of + self.outof) * same >= self.of * (F.size("x") + F.size("y"))).select("a", "b"))

    def sets(self, keys: DataFrame) -> DataFrame:
        """key, found: the whole sets of some nodes, made from their texts anew."""
        wanted = cut(keys.join(self.nodes.select("key", "text_hash"), "key").select("text_hash"))
        asked = _among(self.texts, wanted, "text_hash", "left_semi").select("id", "text_hash", "text")
        made = _with_shingles(asked, {"key": "long", "found": "array<long>"}, lambda s: (key_of(s), s.view(np.int64)), self.shingle)
        return cut(made.groupBy("key").agg(F.first("found").alias("found")))

    def links(self) -> DataFrame:
        """(a, b) edges whose components are those of all pairs that meet in a list and are similar.

        A list isn't expanded at once. Each round compares its members with one of them,
        the one that meets most others, and pairs of the same component need no further
        comparison. In what is left of a list after that the shared bytes of all its pairs are
        tallied in blocks, those that share enough are verified there, and only links come out.
        """
        lists = self.lists()
        members = lists.select("h", "key", "reach", "size", F.col("key").alias("label"), F.lit(False).alias("done"))
        edges = None
        for k in range(self.rounds):
            turn = members if k == 0 else members.where(F.col("size") > self.short)
            best = turn.where("not done").groupBy("h").agg(F.max(F.struct("reach", "key", "label")).alias("p")).select("h", F.col("p.key").alias("pivot"), F.col("p.label").alias("own"))
            met = turn.join(best, "h").where("label <> own and not done")
            pairs = cut(met.select(F.least("pivot", "key").alias("a"), F.greatest("pivot", "key").alias("b")).distinct())
            new = self.verified(pairs)
            edges = new if edges is None else edges.union(new)
            members = cut(self._open(members.join(best.select("h", "pivot"), "h", "left"), edges))
            if members.isEmpty():
                return edges
        return edges.union(cut(self.within(members.where("not done"))))

    def within(self, members: DataFrame) -> DataFrame:
        """(a, b) of all similar pairs of different components in a list; other pairs never become rows.

        A pair is looked at in the first list that both are in. Long lists are dealt out
        over pairs of chunks.
        """
        sizes = members.groupBy("h").agg(F.ceil(F.count("*") / LIST_CHUNK).cast("int").alias("chunks"))
        sets = self.sets(members.select("key").distinct())
        own = members.select("h", "key", "label").join(self.nodes.select("key", "n", "sig").join(sets, "key"), "key").join(sizes, "h")
        own = own.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = own.select("h", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "key", "label", "n", "sig", "found")
        of, outof = self.of, self.outof

        def each(table: pa.Table) -> pa.Table:
            band, low, high = table["h"][0].as_py() >> 8 * BAND, table["low"][0].as_py(), table["high"][0].as_py()
            chunk, key, label, n = (table[c].to_numpy() for c in ("chunk", "key", "label", "n"))
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, POSITIONS)
            lists = table["found"].combine_chunks()
            values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            left, right = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high)
            found: list[tuple[int, int]] = []
            for a in left.tolist():
                b = right[(label[right] != label[a]) & (outof * np.minimum(n[right], n[a]) >= of * np.maximum(n[right], n[a]))]
                if low == high:
                    b = b[b > a]
                same = sig[b] == sig[a]
                b = b[(same.sum(axis=1) >= LEAST_SHARED) & ~same[:, : BAND * band].reshape(len(b), band, BAND).all(axis=2).any(axis=1)]
                if len(b):
                    own, others = values[ends[a] : ends[a + 1]], [values[ends[k] : ends[k + 1]] for k in b.tolist()]
                    whole = np.concatenate(others)
                    hit = own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole
                    shared = np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
                    found += [(int(key[a]), int(key[k])) for k in b[(of + outof) * shared >= of * (n[a] + n[b])].tolist()]
            return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

        return dealt.groupBy("h", "low", "high").applyInArrow(each, "a long, b long")

    @staticmethod
    def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
        """The lists whose members are not of one component yet; a pivot has met all the others of its list."""
        label = connected_components(edges).select(F.col("node").alias("key"), "component")
        named = _among(members.drop("label"), label, "key", "left").select("h", "key", "reach", "size", F.coalesce("component", "key").alias("label"), (F.col("done") | F.coalesce(F.col("key") == F.col("pivot"), F.lit(False))).alias("done"))
        named = cut(named)
        several = named.where("not done").groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
        return named.join(several, "h", "left_semi")


def components(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: tuple[int, int] = SIMILARITY, short: int = SHORT, rounds: int = ROUNDS) -> DataFrame:
    """id, text_hash, component of every row of docs, texts without words being copies of each other."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    made = {"key": "long", "n": "long", "sig": "binary"}
    prints = cut(_with_shingles(texts, made, lambda s: (key_of(s), len(s), signature(s).tobytes()), shingle))
    root = connected_components(_Similar(texts, prints, shingle, similarity, short, rounds).links()).select(F.col("node").alias("key"), F.col("component").alias("root"))
    return _among(prints.select("id", "text_hash", "key"), root, "key", "left").select("id", "text_hash", F.coalesce("root", "key").alias("component"))


def keep_one(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents but for near copies: one row of each component of the given Jaccard similarity stays.

    It is the row of the smallest doc_id (rows without one come last), then of the
    smallest hash of the text, then the smallest row. Rows that share a doc_id but not
    their text, and rows without a doc_id, are documents like others. Texts without words
    are copies of each other. An empty table stays empty.
    """
    rows = cut(components(docs, shingle, similarity).groupBy("component", "id", "text_hash").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash")).alias("first")
    chosen = rows.groupBy("component").agg(first).select(F.col("component").alias("of"), F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    # rows that go, and rows that stay but come several times
    other = cut(rows.join(chosen, rows["component"] == chosen["of"]).withColumn("stays", is_first).where("not stays or n > 1").select("id", "text_hash", "stays"))
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    own = lambda few: hashed["doc_id"].cast("long").eqNullSafe(few["id"]) & (hashed["_hash"] == few["text_hash"])
    repeated = other.where("stays")
    single = _among(hashed, other, own(other), "left_anti").select(*docs.columns)
    once = _among(hashed, repeated, own(repeated), "left_semi").groupBy("doc_id", "_hash").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.union(once)
