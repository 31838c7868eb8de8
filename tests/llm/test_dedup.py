import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factmill.llm import embedding_dedup, simhash_dedup
from factmill.llm.common import connected_components


def components(nodes, linked):
    """Smallest node reachable, by plain search."""
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                if (m := todo.pop()) not in out:
                    out[m] = n
                    todo += [x for x in nodes if linked(m, x)]
    return out


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(3, 3), (None, 4), (1, 2), (2, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == components({x for p in real for x in p}, lambda m, x: (m, x) in real or (x, m) in real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    base = [rnd.choice(words) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 40)))) for i in range(100, 130)]
    for i in range(40):  # near copies of one text
        copy = list(base)
        copy[rnd.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy)))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "One"), (204, "one"), (205, "a b"), (None, " ".join(base)), (None, "nothing like it"), (206, "ÀÉ a b c"), (203, "One")]
    rows.append((207, "long " * 30_000))
    prints = {t: brute_fingerprint(t) for _, t in rows}
    want = components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[want[prints[t]]] = min(i, least.get(want[prints[t]], i))
    expected = sorted((-1 if i is None else i, f"{prints[t]:016x}", least.get(want[prints[t]])) for i, t in rows)
    found = simhash_dedup.near_duplicates(docs(*rows))
    assert sorted((-1 if r["id"] is None else r["id"], r["fingerprint"], r["component_id"]) for r in found.collect()) == expected
    assert simhash_dedup.near_duplicates(docs()).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_byte_index(spark, bits):
    """Every pair within the radius, with its tally of shared bytes, and no other; lists of thousands under common bytes."""
    rnd = random.Random(bits)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    center = rnd.getrandbits(64)
    fps = {center, 0, 1, 3, (1 << 64) - 1, 1 << 63} | {rnd.getrandbits(64) for _ in range(300)}
    fps |= {flip(center, rnd.randrange(1, 5)) for _ in range(200)} | {(center & ~0xFFFF) | rnd.getrandbits(16) for _ in range(100)}
    fps = sorted(fps)
    want = {}
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (d := (x ^ y).bit_count()) <= bits:
                want[frozenset((x, y))] = (sum((x ^ y) >> 8 * k & 255 == 0 for k in range(8)), d)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = simhash_dedup.links(spark.createDataFrame(signed, "fp long"), bits).collect()
    assert len(got) == len(want) > 50 and {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))): (r["shared"], r["bits"]) for r in got} == want
    assert all(shared >= 8 - bits for shared, _ in want.values())


def test_embeddings(spark):
    rnd = random.Random(6)
    unit = lambda n=64: [rnd.gauss(0, 1) for _ in range(n)]
    near = lambda v, s: [x + rnd.gauss(0, s) for x in v]
    a, b = unit(), unit()
    vectors = [(i, near(a, 0.09), i % 2) for i in range(60)] + [(100 + i, near(b, rnd.uniform(0.05, 0.3)), 1) for i in range(40)] + [(200 + i, unit(), 1) for i in range(60)]
    vectors += [(300, [3 * x for x in a], 1), (301, list(a), 1), (302, list(a), 1), (303, list(a), None), (304, None, 1), (305, [], 1), (306, [0.0] * 64, 1)]
    vectors += [(307, [None, *a[1:]], 1), (308, [float("nan"), *a[1:]], 1), (309, [float("inf"), *a[1:]], 1), (310, a[:5], 1), (311, a[:5], 1), (312, [1e200 * x for x in b], 1)]
    vectors += [(None, list(a), 1), (302, list(a), 1), (302, list(b), 1), (302, unit(), 0), (None, unit(), 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("block", F.lit(2)).withColumn("row", F.lit(3))

    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = {k: (v, label) for k, (_, v, label) in enumerate(vectors) if usable(v, label)}

    def cosine(u, v):
        scale = lambda w: [x / max(map(abs, w)) for x in w]
        u, v = scale(u), scale(v)
        return sum(x * y for x, y in zip(u, v, strict=True)) / math.sqrt(sum(x * x for x in u) * sum(y * y for y in v))

    close = {(i, j) for i in good for j in good if i != j and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and cosine(good[i][0], good[j][0]) >= 0.98}
    roots = components(set(good), lambda m, x: (m, x) in close)
    least = {}
    for k, r in roots.items():
        if vectors[k][0] is not None:
            least[r] = min(vectors[k][0], least.get(r, vectors[k][0]))
    want = [(i, sum(1 for p in close if p[0] == k), least.get(roots[k]) if k in roots else i) for k, (i, _, _) in enumerate(vectors)]
    want = sorted(((*w, w[0] == w[2] or w[2] is None) for w in want), key=str)
    for leaf in (2, 8, 4096):  # deep trees and many chunks, and neither
        got = [tuple(r) for r in embedding_dedup.near_duplicates(df, leaf=leaf).collect()]
        assert sorted(got, key=str) == want
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_cells_hold_every_near_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16)) * 0.125
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * 0.02
    budget = 0.01
    for depth in (0, 1, 5, 12):
        posted = {}
        for rows, cell, own in embedding_dedup.cells(x, depth, budget):
            for r, c, o in zip(rows, cell, own):
                assert (c, r) not in posted.get("seen", set())
                posted.setdefault(int(c), []).append((int(r), bool(o)))
        for i in range(300):
            for j in range(i + 1, 300):
                if ((x[i] - x[j]) ** 2).sum() <= budget:
                    both = [c for c, m in posted.items() if {i, j} <= {r for r, _ in m} and any(o for r, o in m if r in (i, j))]
                    assert len(both) == 1, (depth, i, j)


def test_shingle_copies(spark, docs):
    """The pipeline's stage keeps one row of each component of five-word Jaccard 0.8, as plain search does."""
    import corpus_pipeline

    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    rows, passage = [], text(30)
    for family in range(12):
        base = text(rnd.randrange(20, 200))
        for i in range(8 if family else 45):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = "changed"
            rows.append((100 * family + i, " ".join(copy)))
    rows += [(2000 + i, " ".join(text(30) + passage + text(20))) for i in range(50)]
    rows += [(3000, None), (3001, " \n"), (3002, "One two"), (3003, "one  TWO"), (3004, "a b c d e"), (3004, "a b c d e")]
    grams = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})((t or "").lower().split())
    sets = {i: grams(t) for i, t in rows}
    want = components(set(sets), lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])))
    near = {i for i in want if want[i] != i and (simhash_dedup.fingerprint(dict(rows)[i]) ^ simhash_dedup.fingerprint(dict(rows)[want[i]])).bit_count() > 2}
    assert len(near) > 20  # these the fingerprints' contract left in
    kept = corpus_pipeline.distinct(spark, docs(*rows), "")
    assert kept.columns == docs(*rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    for short, rounds in ((1, 3), (8, 1), (100, 2)):
        got = {r["id"]: r["component"] for r in simhash_dedup.components(docs(*rows), short=short, rounds=rounds).collect()}
        assert {(i, j) for i in got for j in got if got[i] == got[j]} == {(i, j) for i in want for j in want if want[i] == want[j]}
    assert simhash_dedup.keep_one(docs()).count() == 0


def test_rows_that_share_or_lack_ids(spark, docs):
    """Different texts of one doc_id all stay; of rows without a doc_id each group keeps one."""
    import corpus_pipeline

    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue black white grey")
    kept = corpus_pipeline.distinct(spark, docs((1, a), (1, b), (2, a), (None, c), (None, c), (None, b)), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (0, c)])
