import random
import re

import pytest

from strandlog.llm import winnowing as W

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, span=8):
    windows = {}
    for i, t in items:
        w = low(t)
        if w and i is not None:
            n = min(span, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = low(t), set(), set()
        for n in range(1, span + 1):
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((str(i), len(w), len(hit), len(found), ",".join(sorted(found)), len(found) >= 2))
    return sorted(out)


def corpus(rng):
    new = lambda n: [rng.choice("abcde") + rng.choice(["", "é", "1"]) for _ in range(n)]
    items = [(i, " ".join(new(n))) for i, n in enumerate([1, 3, 7, 8, 9, 12, 30, 30, 40, 8])] + [(90, None), (91, "!"), (None, "a b c"), (6, "Zz zz " * 10), (10, "q q q q q q q q q q q q")]
    rows = [(0, None), (1, ""), (2, " .,"), (None, "A1!b É-x_y"), (3, "q " * 40)]
    for i in range(4, 50):
        words = new(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            source = low(rng.choice(items)[1])
            lo = rng.randint(0, max(0, len(source) - 9))
            at = rng.choice([0, len(words), rng.randint(0, len(words))])
            words[at:at] = source[lo : lo + rng.randint(6, 20)]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 2 else " ".join(words)))
    return rows + [rows[20], rows[20]], items


@pytest.mark.parametrize("options", [{}, {"k": 6, "most_broadcast": 0, "most_bytes": 0, "most_keys": 0}])
def test_against_brute_force(spark, options):
    rows, items = corpus(random.Random(len(options)))
    docs = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, hits array<int>").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = W.decontaminate(docs, bench, **options).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == brute(rows, items)


def test_every_shared_span_shares_a_fingerprint(spark):
    rng = random.Random(4)
    lines = [(i, [rng.choice("ab") for _ in range(30)]) for i in range(12)]
    df = spark.createDataFrame([(i, x, a[x : x + 8]) for i, a in lines for x in range(23)], "i int, x int, words array<string>")
    kept = {(r.i, r.x): set(r.f) for r in df.select("i", "x", W.fingerprints("words", 4, 5).alias("f")).collect()}
    whole = {r.i: set(r.f) for r in spark.createDataFrame(lines, "i int, words array<string>").select("i", W.fingerprints("words", 4, 5).alias("f")).collect()}
    assert all(len(f) == 1 and f <= whole[i] for (i, _), f in kept.items())
    for i, a in lines:
        for j, b in lines:
            for x in range(23):
                for y in range(23):
                    if a[x : x + 8] == b[y : y + 8]:
                        assert kept[i, x] == kept[j, y]


def test_runs_are_hashed_by_their_words(spark):
    rng = random.Random(5)
    words = [rng.choice("abc") for _ in range(40)]
    for r in spark.createDataFrame([(words,)], "w array<string>").select(W.runs("w", range(1, 8)).alias("r")).first().r:
        grams = [tuple(words[i : i + r.size]) for i in range(len(words) - r.size + 1)]
        assert len(r.hashes) == len(grams) and len(set(grams)) == len(set(r.hashes)) == len(set(zip(grams, r.hashes)))


def test_capital_letters_and_forms_of_one_letter(spark):
    docs = [(1, "x ΑΣ'Β y"), (2, "x ας Β y"), (3, "X ΑΣ-Β Y"), (4, "x İI y"), (5, "x ıi y"), (6, "x İi Y")]
    items = [(1, "x ΑΣ Β y"), (2, "x İI y")]
    got = W.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got) == brute(docs, items)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert W.decontaminate(docs.limit(0), bench).count() == 0
    assert [(r.n_hit, r.n_items) for r in W.decontaminate(docs, bench.limit(0)).collect()] == [(0, 0)]
