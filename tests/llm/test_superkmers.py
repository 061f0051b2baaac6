import hashlib
import random
import re

import pyarrow as pa

from strandlog.llm import common as C
from strandlog.llm import superkmers as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, window):
    """(n_words, n_removed, kept) for each (doc_id, text)."""
    low = lambda i: -1 if i is None else i
    all_words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, all_words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (low(i), s)), (low(i), s))
    out = []
    for (i, _), w in zip(rows, all_words):
        gone = {x for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (low(i), s) for x in range(s, s + window)}
        out.append((str(i), len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


def corpus(rng):
    new = lambda n: [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(n)]
    passage, rows = new(60), [(0, None), (1, ""), (2, "  \n"), (None, "a " * 40), (3, "a\x85 b " * 30)]
    for i in range(4, 60):
        words = new(rng.randint(0, 90))
        if rng.random() < 0.6:
            lo = rng.randint(0, 30)
            at = rng.randint(0, len(words))
            words[at:at] = passage[lo : lo + rng.randint(10, 40)]
        if rng.random() < 0.3 and len(rows) > 8:
            copy = (rows[rng.randrange(5, len(rows))][1] or "").split()
            if copy:
                copy[rng.randrange(len(copy))] = "edited"
            words = copy
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows + [rows[30], rows[30], (70, rows[31][1])]


def test_against_brute_force(spark):
    for seed in range(2):
        rows = corpus(random.Random(seed))
        docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, m int").repartition(3)
        got = S.dedup(docs, window=12, seed_words=4).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute(rows, 12)


def test_super_kmers_tile_all_windows():
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 5, 20, 21, 400)] + [None]
    row, begin, n, low = S.super_kmers(*C.words(pa.array(texts)), 20, 8)
    got = {(r, s + i) for r, s, k in zip(row.tolist(), begin.tolist(), n.tolist()) for i in range(k)}
    assert got == {(r, s) for r, t in enumerate(texts) for s in range(len((t or "").split()) - 19)}
    assert len(got) == n.sum()


def test_query_digest_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "x " * 25), (2, "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.op7_super_kmers(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_removed) == (25, 24)
    assert got[1].kept_sha256 == hashlib.sha256(b"x").hexdigest()
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
