import random

from pyspark.sql import functions as F

from strandlog.llm import urls as U

URLS = [
    None, "", "no scheme.net/", "http://NET/", "http://a.net", "http://a.net/", "http://xnet/", "http://B.example.NET/en/x?q=1#f", "http://example.net/EN/", "http://example.net/english",
    "https://example.com/de/", "https://www.example.com/de", "ftp://example.org/fr/a://b", "http://org/fr/", "http://user@h.org:80/fr/?x", "x://a?b/c.net/", "x://a#.net/", "x:///de/", "http://a.net/\n", "http://äb.net/ü?&&",
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = lambda text, ends: text[: min([i for i, c in enumerate(text) if c in ends], default=len(text))]
    raw = cut(rest, "/?#")
    path = cut(rest[len(raw) :], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(t), t, k) for k, t in U.RULES if (h := t.partition("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(t[len(h) :])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "x")], "page_id long, url string, host string")
    got = U.judge(pages, trees=2).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id] if r.page_id is not None else "http://a.net/")
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def reach(node, bins):
    while node.feature is not None:
        node = node.left if bins[node.feature] <= node.cut else node.right
    return node.value


def test_trees_learn_and_score_as_they_read(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(30)) + "?" + "&".join(f"a{j}=1" for j in range(rng.randint(3, 6))) if bad else "/".join(rng.choice(["one", "two"]) for _ in range(3))
        rows.append((i, f"http://{'x.net' if bad else 'www.example.net'}/{'en/' if not bad else ''}{tail}" if i < 300 else f"http://c.com/{tail}", bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in U.judge(pages).collect()}
    assert all((got[i].verdict == "block") == bad for i, _, bad in rows)
    assert sum((r.score > 0) == rows[r.page_id][2] for r in got.values()) > 380
    rule, verdict = U.rule_of(U.RULES)
    split = U.split_url(pages).withColumn("label", F.when(verdict == "block", 1).when(verdict == "allow", 0))
    bins = U.featured(split, "url")
    trees = U.fit(bins)
    for r in bins.collect():
        mine = {k: r[f"f_{k}"] for k in U.FEATURES}
        assert abs(sum(reach(t, mine) for t in trees) - got[r.page_id].score) < 1e-9


def test_features(spark):
    row = U.featured(U.split_url(spark.createDataFrame([("http://a.bb.org/x/yyyyyy/?p=1&q=22#z",)], "url string")).withColumn("label", F.lit(None).cast("int")), "url").first()
    assert (row.f_depth, row.f_parameters, row.f_host_labels, row.f_host_length, row.f_longest_segment, row.f_suffix_blocked, row.f_suffix_frequency) == (2, 2, 3, 4, 3, 15, 0)


def test_suffix_statistics_leave_out_their_fold(spark):
    hosts = [f"h{i}.{s}" for i in range(30) for s in ("aa", "bb", "cc")]
    label = lambda h: 1 if h.endswith("aa") else None if h.endswith("bb") and int(h[1:-3]) % 5 == 4 else int(h.endswith("bb") and int(h[1:-3]) % 3 == 0)
    rows = spark.createDataFrame([(h, "/", "http://" + h, label(h)) for h in hosts], "host string, path string, url string, label int")
    told = [x for x in map(label, hosts) if x is not None]
    share = sum(told) / len(told)
    fold = {r.host: r.f for r in rows.select("host", F.expr("pmod(xxhash64(host), 5) as f")).collect()}
    for r in U.featured(rows, "url").collect():
        if not r.host.endswith("bb"):  # one label only
            assert (r.f_suffix_blocked, r.f_suffix_frequency) == (int(31 * share), 0)
            continue
        others = [label(h) for h in hosts if h.endswith("bb") and label(h) is not None and (r.label is None or fold[h] != fold[r.host])]
        assert r.f_suffix_blocked == int(31 * (sum(others) + 20 * share) / (len(others) + 20)) and r.f_suffix_frequency == 4


def test_held_out_hosts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(30)) if bad else "one/two"
        rows.append((f"http://h{i % 90}.{'example.net' if not bad else 'x.net'}/{'en/' if not bad else ''}{tail}",))
    right, n = U.held_out(spark.createDataFrame(rows, "url string"), features=["length", "depth", "digits"], trees=3)
    assert right > 0.95 and 40 < n < 250


def test_nothing_to_learn_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [(r.verdict, r.score) for r in U.judge(pages).collect()] == [("allow", None)]
    assert U.judge(pages.limit(0)).count() == 0
