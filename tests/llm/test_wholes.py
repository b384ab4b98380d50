"""The conversation trie, the Merkle manifest and the removal of repeats, each against a plain version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsift.llm import catalog, common, merkle, prefix_trie, substring_dedup

from .conftest import ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df):
    return ordered(tuple(r) for r in df.collect())


# The trie.

def plain_trie(turns, head=prefix_trie.crc_head, block=100):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    said = {c: [s for _, _, s in sorted(rows)] for c, rows in own.items()}
    rebuilt = {c: said.get(c - c % block, [])[:head(c)] + s[head(c):] for c, s in said.items()}
    members, children, below = defaultdict(list), defaultdict(int), defaultdict(lambda: [0, 0])
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in sorted(members, key=len, reverse=True):
        below[n][0] += not children[n]
        below[n][1] += (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
        if n:
            below[n[:-1]][0] += below[n][0]
            below[n[:-1]][1] += below[n][1]
    return ordered((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], *below[n],
                    digest(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(n)))) for n, m in members.items())


def trie_rows(df):
    return rows_of(df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


TURNS = "conv_id long, turn long, role string, text string, node string, PLACE long"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], TURNS).repartition(3)


def test_trie_of_a_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    assert trie_rows(catalog.op11_prefix_trie(spark, sf)) == plain_trie([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_odd_turns(spark):
    rows = [(None, 0, "user", "lost"), (200, None, None, None), (200, 0, "", ""), (200, 1, "user", "é" * 9), (201, 0, "user", "a"), (201, 0, "user", "b"),
            (201, 0, "user", "a"), (307, 0, "user", "no base"), (307, 1, "assistant", "x"), (203, 3, "user", "word " * 20_000), (203, 4, None, "end"), (203, 4, None, "end")]
    rows += [(c, t, "user", f"{t}") for c in (205, 206, 207) for t in range(9)] + [(209, t, "user", f"{t}") for t in range(300)]
    assert trie_rows(prefix_trie.prefix_trie(turns_frame(spark, rows))) == plain_trie(rows)


def test_trie_of_copies_and_blocks(spark):
    random.seed(5)
    rows = [(c, t, "user", random.choice("ab")) for c in range(120) for t in range(random.randrange(1, 8))]
    rows += [(1000 + c, t, "user", "same") for c in range(60) for t in range(4)]
    found = prefix_trie.prefix_trie(turns_frame(spark, rows), head=lambda c: c % 3, block=10)
    assert trie_rows(found) == plain_trie(rows, lambda c: c % 3, 10)
    # The reference of each node's last turn leads to a turn of the same depth's content.
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append(text)
    for r in found.where("depth > 0").collect():
        own = (said.get(r.conv_id - r.conv_id % 10, [])[:r.conv_id % 3] + said[r.conv_id][r.conv_id % 3:])
        assert said[r.turn_conv][r.turn_no] == own[r.depth - 1]


def test_trie_without_turns(spark):
    assert prefix_trie.prefix_trie(turns_frame(spark, [(1, 0, "user", "x")]).where("conv_id = 2")).collect() == []


def test_colliding_fingerprints_are_found_out(spark, monkeypatch):
    good = prefix_trie.multiplier
    # With multiplier 0 only the last turn counts, so different prefixes with one last turn share a name.
    monkeypatch.setattr(prefix_trie, "multiplier", lambda seed: 0 if seed == 0 else good(seed))
    rows = [(c, t, "user", f"{c} {t}" if t < 6 else "bye") for c in (1, 2) for t in range(8)]
    assert trie_rows(prefix_trie.prefix_trie(turns_frame(spark, rows))) == plain_trie(rows)


def test_products_form_a_monoid():
    base, digests = prefix_trie.multiplier(0), [hashlib.sha256(bytes([i])).digest() for i in range(9)]
    whole = prefix_trie.products(digests, base)
    for cut in range(10):
        head, tail = prefix_trie.products(digests[:cut], base)[-1], prefix_trie.products(digests[cut:], base)[-1]
        assert (head * pow(base, 9 - cut, prefix_trie.PRIME) + tail) % prefix_trie.PRIME == whole[-1]


# The manifest.

def plain_leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def plain_tree(leaves):
    paths, own, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, k in enumerate(own):
            a = k // 3 * 3
            paths[i].append(("".join(level[a:k]), "".join(level[k + 1:a + 3])))
            own[i] = k // 3
        level = [digest("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_proofs(rows):
    """rows of (doc_id, text, lang, source, n_chars)"""
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([leaf for *_, leaf, _ in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    if not order:
        return []
    root, tops = plain_tree([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, leaf, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), built[s][1]):
            cut = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = plain_leaf(r, r[1].replace("\n", "") if cut else r[1])
            for left, right in path + top:
                fold = digest(left + fold + right)
            out.append((r[0], leaf, built[s][0], root, digest("".join(a + b for a, b in path + top)), fold, fold == root))
    return ordered(out)


def test_manifest_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    found = rows_of(catalog.op12_merkle_manifest(spark, sf))
    assert found == plain_proofs([tuple(r) for r in docs.collect()])
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 10, 28])
def test_manifest_of_few_rows(spark, size):
    rows = [(i // 2, f"line\n{i}", None, "abc"[i % 2 * (i % 3)], i) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(merkle.proofs(docs.repartition(3), merkle.without_breaks())) == plain_proofs(rows)


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    more = [(i, "copy\n", "en", s, 5) for i in range(30, 60) for s in (None, "", "é", "z")] + [(77, "same", "en", "z", 4)] * 5
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert rows_of(merkle.proofs(docs, merkle.without_breaks())) == plain_proofs(rows)
    assert merkle.proofs(no_docs, merkle.without_breaks()).collect() == []


def test_numbers_in_order(spark):
    random.seed(2)
    rows = [(random.choice([None, "", "a", "a", "a", "b"]), random.choice([None, *range(50)])) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "group string, nth long").repartition(7)
    for within in ("group", None):
        found = sorted((tuple(r) for r in common.numbered(docs, ["group", "nth"], within).collect()), key=lambda r: (r[0] is not None, r[0] or "", r[2]))
        want, last, n = [], (), 0
        for g, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0)):
            n = n + 1 if (g,) == last or (within is None and last) else 0
            last = (g,)
            want.append((g, v, n))
        assert found == want


# Repeats.

def plain_repeats(rows, window=50):
    least, said = {}, [WORD.findall(t or "") for _, t in rows]
    for (k, _), words in zip(rows, said):
        for i in range(len(words) - window + 1):
            w = tuple(words[i:i + window])
            least[w] = min(least.get(w, float("inf")), float("inf") if k is None else k)
    out = []
    for (k, _), words in zip(rows, said):
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i:i + window])] < (float("inf") if k is None else k):
                gone.update(range(i, i + window))
        out.append((k, len(words), len(gone), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return ordered(out)


def test_repeats_of_a_table(spark, sf, texts):
    found = rows_of(catalog.op13_substring_dedup(spark, sf))
    assert found == plain_repeats(list(texts.items()))
    assert any(r[2] for r in found)


def test_repeats_of_odd_rows(spark, odd_docs, no_docs):
    words = [str(i) for i in range(400)]
    more = [(20, " ".join(words[:120])), (21, " ".join(words[30:90])), (None, "\t".join(words[60:300])), (22, "\n".join(words[100:])), (23, " ".join(words[:49])),
            (23, " ".join(words[300:350])), (23, " ".join(words[300:350])), (24, "word " * 500), (25, "é " * 80), (26, "é " * 70 + "e")]
    docs = odd_docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    assert rows_of(substring_dedup.without_repeats(docs)) == plain_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert substring_dedup.without_repeats(no_docs).collect() == []


@pytest.mark.parametrize("window, seed", [(50, 1), (10, 2), (3, 3), (50, 4)])
def test_repeats_of_random_texts(spark, monkeypatch, window, seed):
    random.seed(seed)
    pool = [[str(random.randrange(1000)) for _ in range(300)] for _ in range(6)]

    def text():
        kind = random.random()
        if kind < .2:
            return random.choices("ab", k=random.randrange(150))
        if kind < .4:
            return [random.choice("abcd")] * random.randrange(300)
        if kind < .5:
            return (list("abcdefg")[:random.randrange(1, 8)] * 100)[:random.randrange(300)]
        out = []
        for _ in range(3):
            a = random.randrange(250)
            out += random.choice(pool)[a:a + random.randrange(200)] if random.random() < .5 else random.choices("pqrstuvwxyz", k=random.randrange(80))
        return out

    rows = [(random.choice([None, random.randrange(200)]) if random.random() < .1 else i, random.choice([" ", "\n"]).join(text())) for i in range(200)]
    monkeypatch.setattr(common, "ARROW_ROWS", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(substring_dedup.without_repeats(docs, window)) == plain_repeats(rows, window)


def test_symbols_follow_from_their_reach():
    random.seed(9)
    for _ in range(60):
        shared = np.array(random.choices(range(3 if random.random() < .5 else 50), k=60), np.uint64)
        found = []
        for side in range(2):
            left, right = (np.array(random.choices(range(50), k=random.randrange(40)), np.uint64) for _ in range(2))
            words = common.mix(np.concatenate([left, shared, right]))
            name, start, low, high, _ = substring_dedup.recompress(words, np.array([0, len(words)]))
            inside = (low >= len(left)) & (high <= len(left) + 60)
            found.append(set(zip(name[inside].tolist(), (start[inside] - len(left)).tolist(), (low[inside] - len(left)).tolist(), (high[inside] - len(left)).tolist())))
        assert found[0] == found[1]


def test_names_of_stretches_tell_words_apart():
    block = substring_dedup.Block(pa.array(["a b c d a b c", "x a b c y", ""]))
    one, two = block.stretches(np.array([0, 4, 8, 1]), np.array([3, 7, 11, 4]))
    assert len(set(one.tolist())) == 2 and len(set(two.tolist())) == 2 and one[0] == one[1] == one[2]


def test_no_row_is_cut_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 200)
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    base = [str(i) for i in range(200)]
    rows = [(i, " ".join(base[i:i + 100])) for i in range(0, 100, 10)] + [(100 + i, " ".join(base)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert rows_of(substring_dedup.without_repeats(docs)) == plain_repeats(rows)
    assert docs.agg(F.count("*")).first()[0] == len(rows)
