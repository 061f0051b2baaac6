import random

import numpy as np

from strandlog.llm import langid as L

SOUNDS = {"xx": "th an re ing of the", "yy": "ung ein sch keit zu der", "zz": "eau é ment que ç le"}


def corpus(n, rng):
    return [(i, " ".join("".join(rng.choice(SOUNDS[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), k) for i in range(n) for k in [rng.choice(list(SOUNDS))]]


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    net = L.fresh(["a", "b", "c"], 4, rng)
    for name in ("tables", "own", "bias"):
        setattr(net, name, [x.astype(np.float64) for x in getattr(net, name)])
    net.out, net.shift = net.out.astype(np.float64), net.shift.astype(np.float64)
    data, label = rng.integers(90, 130, (11, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = L.gradients(net, data, label)
    for weight, grad in zip(net.weights(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        near = []
        for by in (1e-3, -2e-3):
            weight[at] += by
            near.append(L.gradients(net, data, label)[0])
        weight[at] += 1e-3
        assert abs((near[0] - near[1]) / 2e-3 - grad[at]) < 1e-3 * max(1, abs(grad[at]))


def test_reader_agrees_with_a_plain_loop():
    rng = np.random.default_rng(2)
    net = L.fresh(["a", "b"], 3, rng)
    texts = [b"", b"One", "é".encode() * 50, bytes(rng.integers(32, 122, 200).astype(np.uint8)), b"12"]
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
    got = L.Reader(net).texts(np.frombuffer(b"".join(texts), np.uint8), at)
    for text, row in zip(texts, got):
        raw, total, seen = L.FOLD[np.frombuffer(text, np.uint8)], np.zeros(2), 0
        for lo in range(0, len(raw), L.WINDOW):
            data, both = np.append(raw[lo : lo + L.WINDOW], np.zeros(max(0, L.WINDOW - len(raw) + lo), np.uint8)), []
            for d in range(2):
                s, out = np.zeros(3), [None] * L.WINDOW
                for t in list(range(L.WINDOW))[:: -1 if d else 1]:
                    x, u = net.tables[d][:, data[t]], net.own[d] @ s
                    z, r = L.sigmoid(x[:3] + u[:3]), L.sigmoid(x[3:6] + u[3:6])
                    n = np.tanh(x[6:] + r * (u[6:] + net.bias[d][:, 0]))
                    s = out[t] = (1 - z) * n + z * s
                both.append(out)
            for t in range(L.WINDOW):
                e = np.exp(net.out @ np.concatenate([both[0][t], both[1][t]]) + net.shift[:, 0])
                total += L.IS_LETTER[data[t]] * e / e.sum()
                seen += L.IS_LETTER[data[t]]
        assert np.allclose(total / max(seen, 1), row, atol=1e-4)


def test_held_out_accuracy_and_defined_results(spark):
    rng = random.Random(3)
    rows = [(i, t, k, 0) for i, t, k in corpus(400, rng)] + [(1000, None, "xx", 0), (1001, "", None, 0), (1002, "12 !", "yy", 0), (None, "thethe anre", "xx", 0), (5, "ung der", None, 0), (1003, "the " * 60000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int").repartition(3)
    net = L.fit(docs.where(~L.is_held_out()), steps=120, lanes=64)
    assert net.langs == sorted(SOUNDS)
    got = L.predict(docs, net).withColumn("held_out", L.is_held_out()).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: k for i, _, k, _ in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {i: ("und", 0.0) for i in (1000, 1001, 1002)}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    again = L.fit(docs.where(~L.is_held_out()), steps=5, lanes=16), L.fit(docs.where(~L.is_held_out()).repartition(5), steps=5, lanes=16)
    assert all((a == b).all() for a, b in zip(again[0].weights(), again[1].weights()))


def test_every_language_is_learned(spark):
    rows = [(1000 * k + i, f"text number {i} of the language", f"l{k:03d}") for k in range(70) for i in range(1 if k == 69 else 2)]
    net = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=1, lanes=4)
    assert net.langs == [f"l{k:03d}" for k in range(70)]
    docs = spark.createDataFrame(rows[:3], "doc_id long, text string, lang string")
    assert all(r.lang_pred in net.langs and 0 < r.score < 1 for r in L.predict(docs, net).collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(docs) is None
    assert [(r.lang_pred, r.score) for r in L.predict(docs, None).collect()] == [("und", 0.0)]
    assert L.predict(docs.limit(0), None).count() == 0
