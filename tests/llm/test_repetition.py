import random
import re

import numpy as np
import pytest

from strandlog.llm import repetition as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    w = WORD.findall(text or "")
    n = len(w)
    m = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            m[i], m[j] = max(m[i], k), max(m[j], k)
    cov = lambda least, exact: len({x for i in range(n) if m[i] >= least for x in range(i, i + (least if exact else m[i]))})
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, cov(3, True), cov(4, False), max(m, default=0)


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a a a a a a", "é\x85x \xa0 y\x0bz\x1cq", "x\n\nx\n \n \nx", "<#> * $%&| <#>"]
    out += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) + "\n" + rng.choice(["b c", ""]) for _ in range(40)]
    return out + ["p q r\n" * 30, "p q r\n" * 30]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts())], "doc_id long, text string, n_words int").repartition(3)
    got = {r.doc_id: r for r in R.score(docs, min_words=4).collect()}
    for i, t in enumerate(texts()):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == want, (i, t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_the_verdict_against_brute_force(spark):
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(60):
        words, run = new(rng.choice([60, 100, 200])), new(rng.choice([9, 10, 11, 16, 31]))
        for _ in range(rng.choice([0, 1, 2, 3])):
            at = rng.randint(0, len(words))
            words[at:at] = run
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in R.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def covered(words):
        where = {}
        for p in range(len(words) - 9):
            where.setdefault(tuple(words[p : p + 10]), []).append(p)
        return len({q for places in where.values() if len(places) > 1 for p in places for q in range(p, p + 10)})

    def longest(words):
        return max((k for k in range(1, 40) if len({tuple(words[p : p + k]) for p in range(len(words) - k + 1)}) < len(words) - k + 1), default=0)

    for i, text in rows:
        words = text.split()
        fine = covered(words) <= 0.2 * len(words) and longest(words) <= 0.15 * len(words)
        assert got[i].kept == (fine and not got[i].base_failed), i
    assert 5 < sum(not r.kept and not r.base_failed for r in got.values()) < 55
    assert any(r.kept and r.covered_words for r in got.values())


def test_repeats_do_not_cross_texts():
    codes, at = np.array([1, 2, 3, 1, 2, 3]), np.array([0, 3, 6])
    assert R.longest_repeats(codes, at).tolist() == [0] * 6


@pytest.mark.parametrize("n", [1, 500])
def test_one_word_over_and_over(n):
    assert R.longest_repeats(np.zeros(n, np.int64), np.array([0, n])).tolist() == ([n - 1] + [n - i for i in range(1, n)] if n > 1 else [0])


def test_empty_table(spark):
    assert R.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
