import random

from strandlog.llm import lines as L


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows, near_chars):
    low = lambda i: -(2**63) if i is None else i
    first = {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n") if t is not None else []):
            x = x.strip(" \t\r\x0b\x0c")
            if x:
                first[x] = min(first.get(x, (low(i), p)), (low(i), p))
    gone = {x for x in first for y in first if len(x) >= near_chars and len(y) >= near_chars and first[y] < first[x] and near(x, y)}
    out = []
    for i, t in rows:
        all_lines = t.split("\n") if t is not None else []
        stay = [x for p, x in enumerate(all_lines) if not (s := x.strip(" \t\r\x0b\x0c")) or (first[s] == (low(i), p) and s not in gone)]
        out.append((str(i), len(all_lines), len(all_lines) - len(stay), "\n".join(stay) if t is not None else None))
    return sorted(out, key=str)


def corpus(rng):
    base = ["".join(rng.choice("abé ") for _ in range(rng.choice([7, 8, 9, 15, 16, 17, 31, 32, 33, 34, 64, 65, 127, 129]))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n \n\t"), (None, base[0] + "\n" + base[5])]
    for i in range(3, 60):
        some = []
        for _ in range(rng.randint(1, 5)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                p = rng.randrange(len(x) + 1)
                x = rng.choice([x[:p] + "z" + x[p:], x[:p] + x[p + 1 :], x[:p] + rng.choice("yw") + x[p + 1 :]])
            some.append(rng.choice(["", "  "]) + x)
        rows.append((i, "\n".join(some)))
    return rows + [rows[20], (70, rows[21][1]), (71, "".join(rng.choice("abc") for _ in range(30000)))]


def test_against_brute_force(spark):
    for seed, most in ((0, 10**6), (1, 0)):
        rows = corpus(random.Random(seed))
        long = rows[-1][1]
        rows += [(72, long[:17000] + long[17001:]), (73, long[:29999] + "q"), (74, "r" + long)]
        docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, pos int").repartition(3)
        got = L.dedup(docs, near_chars=8, most_broadcast=most).collect()
        assert sorted([(str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in got], key=str) == brute(rows, 8)
        assert L.clean(docs, near_chars=8).columns == docs.columns


def test_short_lines_are_compared_too(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))) for _ in range(3))) for i in range(60)]
    rows += [(60 + i, "a short line on" + c) for i, c in enumerate(["e", "f", "", "ee"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted([(str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in L.dedup(docs).collect()], key=str) == brute(rows, 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_wider_bounds_against_brute_force(spark, monkeypatch):
    rows = corpus(random.Random(5))[:45]
    rows += [(80 + i, "".join(x)) for i, x in enumerate(["abcdefghijklmnopqrst", "bcdefghijklmnopqrstu", "abXdefghijklmnopqrYt", "cdefghijklmnopqrst", "abcdefghijklmnopqrstuv", "aabbcdefghijklmnopqrst"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    removed = []
    for edits in (1, 2, 3):
        monkeypatch.setitem(globals(), "near", lambda a, b: a != b and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits)
        got = L.dedup(docs, near_chars=8, edits=edits).collect()
        assert sorted([(str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in got], key=str) == brute(rows, 8)
        removed.append(sum(r.n_removed for r in got))
    assert removed[0] < removed[1] < removed[2]


def test_no_pairs_are_needed_in_a_large_group(spark):
    rows = [(i, "a common line of some length " + chr(0x4E00 + i)) for i in range(300)]
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if not r.n_removed) == [0]


def test_empty_table(spark):
    assert L.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
