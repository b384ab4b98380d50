"""N-gram join and embeddings against all pairs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from flowsift.llm import catalog, common, embedding_dedup, graph, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def groups(items, linked):
    up = list(range(len(items)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(items))]


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent):
    """rows of (key, text) to rows of (key, size, component)."""
    sets = [shingles(t, width) for _, t in rows]

    def linked(a, b):
        o = len(a & b)
        return bool(a) and bool(b) and 100 * o >= percent * (len(a) + len(b) - o)

    tops = groups(sets, linked)
    least = {}
    for (k, _), t in zip(rows, tops):
        if k is not None:
            least[t] = min(least.get(t, k), k)
    return Counter((k, len(s), least.get(t)) for (k, _), s, t in zip(rows, sets, tops))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_join_of_a_table(spark, sf, texts):
    assert found(catalog.op5_ngram_join(spark, sf)) == brute(list(texts.items()), 3, 90)


@pytest.mark.parametrize("width,percent,chunk", [(5, 80, 1 << 20), (3, 90, 400), (5, 80, 300), (1, 60, 100)])
def test_join_of_edited_copies(spark, width, percent, chunk):
    # Families around a text that is not the first of its group, chains, shared passages, and short texts.
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice((3, 9, 20, 60, 150)))]
        for _ in range(rng.choice((1, 4, 25))):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    chain = [word() for _ in range(100)]
    for _ in range(20):
        chain[rng.randrange(100)] = word()
        rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, " ".join([*passage, *(word() for _ in range(rng.randrange(40)))])) for i in range(30)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(ngram_join.similar_groups(df, width, percent, chunk=chunk)) == brute(rows, width, percent)


def test_join_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = Counter()
    for (k, n, c), times in brute(rows, 3, 90).items():
        want[k, n, k if not n else c] += times
    assert found(ngram_join.similar_groups(odd_docs, 3, 90)) == want
    assert ngram_join.similar_groups(no_docs).count() == 0


def meet(rule, a, b, *frequent):
    """Whether two sets meet at as many addresses of some kind as their routing demands."""
    (x, least_x), (y, least_y) = rule.addresses(a, *frequent), rule.addresses(b, *frequent)
    shared = np.intersect1d(x, y)
    for kind in set((shared & np.uint64(255)).tolist()):
        need = [int(least[(keys & np.uint64(255)) == np.uint64(kind)][0]) for keys, least in ((x, least_x), (y, least_y))]
        if (shared & np.uint64(255) == np.uint64(kind)).sum() >= (max if kind % 2 == 0 else min)(need):
            return True
    return False


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(1)
    rule = ngram_join.Rule(80)
    for n in (1, 5, 40, 300, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.95))], rng.integers(0, 1 << 63, n // 50, dtype=np.uint64)]))
        tree = ngram_join.Tree([a, b], 64)
        assert np.minimum(tree.points[0], tree.points[1]).sum() >= ngram_join.overlap(a, b) == len(np.intersect1d(a, b))
        if ngram_join.overlap(a, b) >= rule.needed(len(a), len(b)):
            assert meet(rule, a, b)
            assert 1 in tree.near(tree.points[0], len(a), rule)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90):
        rule = ngram_join.Rule(percent)
        for n in (1, 9, 70, 900, 9000):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for cut in (0.0, 0.05, 0.1, 0.2, 0.4):
                b = np.unique(np.concatenate([a[int(len(a) * cut):], rng.integers(0, 1 << 63, int(n * cut / 3), dtype=np.uint64)]))
                if len(b) and ngram_join.overlap(a, b) >= rule.needed(len(a), len(b)):
                    assert ngram_join.may_link(ngram_join.sketch_of(a), ngram_join.sketch_of(b), rule)
                    frequent = rng.random(ngram_join.CELLS) < rng.choice([0, 0.3, 0.9, 1.0])
                    assert meet(rule, a, b, frequent)


def test_half_a_text_in_common_makes_no_crowd():
    # Half of each set is frequent: before the finer bands all n-grams routed such sets, and their common half joined them all.
    rng = np.random.default_rng(8)
    rule = ngram_join.Rule(80)
    for n in (120, 400, 1500):
        common_half = rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)
        frequent = np.zeros(ngram_join.CELLS, bool)
        frequent[ngram_join.cell_of(common_half)] = True
        keys = []
        for _ in range(3 * ngram_join.FEW):
            own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            own = own[~frequent[ngram_join.cell_of(own)]][:n // 2]
            keys.append(np.unique(rule.addresses(np.unique(np.concatenate([common_half, own])), frequent)[0]))
        assert np.unique(np.concatenate(keys), return_counts=True)[1].max() <= ngram_join.FEW


def test_what_is_shuffled_is_read_back():
    numbers = np.array([0, 1, 255, 256, (1 << 40) - 1], np.int64)
    assert len(ngram_join.narrow(numbers, 5)) == 25
    assert ngram_join.wide(ngram_join.narrow(numbers, 5), 5).tolist() == numbers.tolist()
    assert ngram_join.wide(ngram_join.narrow(numbers, 6), 6).tolist() == numbers.tolist()
    for text in ("", "One", "a B\tc\n d e f \u00e9\u2028g h " * 9):
        packed = zlib.compress(pa.array([text])[0].as_buffer())
        assert ngram_join._unpacked(packed, 3).tolist() == ngram_join.shingle_sets(pa.array([text]), 3)[0].tolist()


def test_meetings_keep_what_shares_an_address():
    rng = np.random.default_rng(6)
    keys = np.concatenate([rng.integers(0, 300, 900), np.full(40, 1000)]).astype(np.uint64)
    nodes = np.concatenate([rng.integers(0, 500, 900), rng.integers(0, 500, 40)]).astype(np.int64)
    least = (nodes % 7 + 1).astype(np.uint8)
    (a, b, kind, times, needed), (go_keys, go_nodes, go_least) = ngram_join.meetings(keys, nodes, least)
    assert (go_least == go_nodes % 7 + 1).all()
    members = {}
    for k, n in zip(keys.tolist(), nodes.tolist()):
        members.setdefault(k, set()).add(n)
    pairs = {(x, y) for x, y in zip(a.tolist(), b.tolist())}
    for k, group in members.items():
        low = min(group)
        want = {(x, y) for x in group for y in group if x > y} if len(group) <= ngram_join.FEW else {(x, low) for x in group if x != low}
        assert want <= pairs
        assert sum(go_keys == k) == min(len(group), ngram_join.FEW + 1)
    assert {(x, y) for x, y, c in zip(a.tolist(), b.tolist(), kind.tolist()) if c < 0} == {
        (x, min(g)) for g in members.values() if len(g) > ngram_join.FEW for x in g if x != min(g)}
    for x, y, c, w, n in zip(a.tolist(), b.tolist(), kind.tolist(), times.tolist(), needed.tolist()):
        if c >= 0:
            assert w == sum({x, y} <= g and k % 256 == c and len(g) <= ngram_join.FEW for k, g in members.items())
            assert n == (max if c % 2 == 0 else min)(x % 7 + 1, y % 7 + 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(900, i) for i in range(901, 950)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {n: i for i, n in enumerate(nodes)}
    pairs = {frozenset((place[a], place[b])) for a, b in edges if a != b}
    tops = groups(list(range(len(nodes))), lambda i, j: frozenset((i, j)) in pairs)
    assert got == {n: nodes[t] for n, t in zip(nodes, tops)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_truth(rows):
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (_, v, l), (_, w, m) = a, b
        if l != m or not usable(v, l) or not usable(w, m) or len(v) != len(w):
            return False
        v, w = np.array(v, float), np.array(w, float)
        return v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98

    degree = [sum(linked(a, b) for j, b in enumerate(rows) if j != i) for i, a in enumerate(rows)]
    tops = groups(rows, linked)
    least = {}
    for (k, _, _), t in zip(rows, tops):
        if k is not None:
            least[t] = min(least.get(t, k), k)
    return Counter((k, d, least.get(t), k is not None and k == least.get(t)) for (k, _, _), d, t in zip(rows, degree, tops))


def vectors_found(df):
    return Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 37])
def test_embeddings_with_planted_neighbours(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, 1, 1):
        for _ in range(15):
            base = rng.standard_normal(64)
            for _ in range(int(rng.integers(1, 6))):
                noise = rng.standard_normal(64)
                angle = rng.choice([0.0, 0.1, 0.19, 0.21, 0.3])
                noise -= noise @ base / (base @ base) * base
                v = base / np.linalg.norm(base) * math.cos(angle) + noise / np.linalg.norm(noise) * math.sin(angle)
                rows.append((len(rows), (v * rng.uniform(0.5, 2)).astype(np.float32).tolist(), label))
    rows += [(len(rows) + i, rows[3][1], 1) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert vectors_found(embedding_dedup.near_duplicates(df, block=block)) == vector_truth(rows)


def test_embeddings_with_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [2.0, 4.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1),
            (9, [None, 1.0], 1), (10, [1.0, 2.0], None), (11, [1.0, 2.0], 2), (12, [1.0, 2.0, 0.0], 1), (13, [-1.0, -2.0], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, node string, key string")
    got = vectors_found(embedding_dedup.near_duplicates(df))
    want = Counter()
    for (k, d, c, kept), n in vector_truth(rows).items():
        want[k, d, c, kept] += n
    assert got == want
    assert embedding_dedup.near_duplicates(df.where("vec_id = -1")).count() == 0


def test_calibration_reaches_the_wanted_recall():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.standard_normal(a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    b = a * 0.98 + noise / np.linalg.norm(noise, axis=1, keepdims=True) * math.sqrt(1 - 0.98**2) * (1 - 1e-9)
    axes = embedding_dedup.directions(64)
    hits = (np.abs(a @ axes - b @ axes) <= embedding_dedup.window(0.98)).sum(1)
    assert (hits >= embedding_dedup.least_collisions()).mean() > 0.999


def test_membership_never_loses_an_id(spark):
    ids = spark.range(-500, 500).select((common.F.col("id") * 982451653).alias("id"))
    bitmap = common.membership(ids, "id", 1 << 12)
    assert common.may_hold(bitmap, np.array([r.id for r in ids.collect()])).all()
    df = spark.createDataFrame([(i, "x") for i in range(100)] + [(None, "y")], "id long, maybe string")
    left = common.without(df, df.where("id % 3 = 0").select("id"), "id")
    assert left.columns == df.columns and sorted(r.id for r in left.where("id is not null").collect()) == [i for i in range(100) if i % 3]
    assert left.where("id is null").count() == 1
