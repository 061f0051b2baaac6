import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from strandlog.llm import simhash as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for _ in range(3000):
        away = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not m & away for m in S.masks(4))
    for pair in combinations(range(64), 2):
        assert any(not m & (1 << pair[0] | 1 << pair[1]) for m in S.masks(4))


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 6, 7])
def test_masks_of_other_radii(radius):
    rng = random.Random(radius)
    masks = S.masks(radius)
    for _ in range(2000):
        away = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not m & away for m in masks)
    assert min(m.bit_count() for m in masks) >= (32 if radius != 7 else 16)


def test_a_bucket_over_many_batches(spark):
    rng = random.Random(7)
    base = rng.getrandbits(63)
    values = sorted({base ^ sum(1 << b for b in rng.sample(range(20), 2)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(20)})
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        edges = S.bucket_edges(distinct, 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    root = {v: v for v in values}
    for _ in values:
        for e in edges:
            root[e.a] = root[e.b] = min(root[e.a], root[e.b])
    want = {v: v for v in values}
    for _ in range(6):
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 4:
                    want[a] = want[b] = min(want[a], want[b])
    assert root == want


def test_fingerprint():
    for text in [None, "", " \n", "A", "é b\x85C D", "a b c d", "a b c d e f a b c d", "X\x0bY\x1cZ Ä b c d e"]:
        assert S.fingerprint(text) == brute(text), text


def test_parts_by_both_ways(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 31, 12, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 31, 12, dtype=np.uint64)) for _ in range(9))]))
    same = lambda r: {tuple(np.flatnonzero(r == x)) for x in r}
    direct = same(S.parts(values, 4))
    monkeypatch.setattr(S, "DIRECT", 1)
    assert same(S.parts(values, 4)) == direct


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  ", "one", "One"]
    for _ in range(12):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 50)) for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(4):
            words[rng.randrange(120)] = "new"
            texts.append(" ".join(words))
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(3 * 5, texts[5], "x"), (None, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    fps = [brute(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    ids = [i for i, _, _ in rows]
    want = sorted((str(ids[i]), f"{fps[i]:016x}", min(ids[j] for j in range(len(rows)) if group[j] == group[i] and ids[j] is not None)) for i in range(len(rows)))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()) == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(9)]
    assert all((brute(a) ^ brute(b)).bit_count() > 4 for a, b in combinations(texts, 2))
    rows = [(None, t) for t in texts[:4]] + [(None, texts[0])]  # components of null ids only, one with a copy
    rows += [(1, texts[4]), (1, texts[5]), (1, texts[5])]  # one id, texts of two components
    rows += [(2, texts[6]), (3, texts[6]), (3, texts[7]), (None, texts[7])]  # a copy under an id that has a text of its own
    rows += [(4, texts[8]), (4, texts[8].upper())]  # one id, two texts of one component
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == sorted([*(("None", t) for t in texts[:4]), ("1", texts[4]), ("1", texts[5]), ("2", texts[6]), ("3", texts[7]), ("4", texts[8])])


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (300, 200)], "a long, b long")
    got = {r.node: r.root for r in S.connected(edges).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[200] == got[300] == 100


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_two_fingerprints_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(None, None), (0, ""), (1, "one")]
    for i in range(2, 40):
        words = [str(rng.randrange(10**6)) for _ in range(rng.choice([60, 200]))]
        for copy in range(rng.choice([1, 2, 4])):
            rows.append((i + 100 * copy, " ".join(words)))
            words[rng.randrange(len(words))] = "edited"
    rng.shuffle(rows)
    prints = [S.two_fingerprints(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    apart = lambda a, b: [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b])]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if min(apart(a, b)) <= 6 and sum(apart(a, b)) <= 24]
    assert any(max(apart(a, b)) > 6 for a, b in links)
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    low = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    want = sorted(low(min((i for i in range(len(rows)) if group[i] == g), key=low)) for g in set(group))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.keep_one(docs, size=5, radius=6, total=24).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == want
    assert S.keep_one(docs.limit(0), size=5, radius=6, total=24).count() == 0
