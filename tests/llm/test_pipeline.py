import random

import corpus_pipeline as P
from strandlog.llm import simhash
from tests.llm import test_lines, test_winnowing

SOUNDS = {"xx": "th an re ing of the", "yy": "ung ein sch keit zu der"}


def corpus(rng):
    new = lambda k, n: " ".join("".join(rng.choice(SOUNDS[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    item = new("xx", 20)
    rows = [(i, "\n".join(new(k, 12) for _ in range(4)), k) for i in range(60) for k in [rng.choice("xy") * 2]]
    rows += [(100, rows[3][1], "xx"), (101, rows[4][1] + "\nthe end of the thing", "xx"), (102, None, "xx"), (103, "12 34", "yy"), (104, "", None), (105, new("xx", 30) + " " + item, "xx"), (106, rows[5][1].replace("a", "e", 1), None)]
    return [(i, t, k, "s", None if t is None else len(t)) for i, t, k in rows], [(1, item)]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus(random.Random(6))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir, steps = str(tmp_path), dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "tokenize"]

    def through(name, now):
        out = steps[name](spark, spark.createDataFrame(now, schema), sf_dir)
        assert name == "tokenize" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        return sorted(map(tuple, out.collect()))

    kept = through("language_id", rows)
    assert [r[0] for r in kept] == [r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])] and set(kept) <= set(rows)
    lined = through("line_dedup", kept)
    want = {int(i): text for i, _, _, text in test_lines.brute([(r[0], r[1]) for r in kept], 1)}
    assert [(r[0], r[1], r[4]) for r in lined] == [(r[0], want[r[0]], len(want[r[0]])) for r in kept]
    single = through("near_dedup", lined)
    group = {r[0]: r[0] for r in lined}
    prints = {r[0]: simhash.two_fingerprints(r[1], P.SHINGLE) for r in lined}
    for _ in group:
        for a in group:
            for b in group:
                apart = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b])]
                if min(apart) <= P.RADIUS and sum(apart) <= P.TOTAL:
                    group[a] = group[b] = min(group[a], group[b])
    assert single == [r for r in lined if group[r[0]] == r[0]]
    clean = through("decontaminate", single)
    hits = {int(i): n for i, _, n, *_ in test_winnowing.brute([(r[0], r[1]) for r in single], items)}
    assert clean == [r for r in single if not hits[r[0]]] and hits[105] > 0
    final = through("tokenize", clean)
    assert [(r[0], r[1] == len(r[2])) for r in final] == [(r[0], True) for r in clean]
    assert sorted(r.doc_id for r in P.run(spark, sf_dir).collect()) == [r[0] for r in clean]
