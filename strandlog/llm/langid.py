"""Language identification by a bidirectional gated recurrent network over bytes.

A GRU reads windows of bytes forwards, another backwards; each position gets a probability of every language from both
states, and a text's probabilities are the mean over its letters' positions. The network is trained in numpy by
backpropagation through time on windows from a bounded sample of labelled texts. Prediction is a map over rows: texts are
cut into windows, which run side by side, so memory doesn't depend on a text's length and every byte is read.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned (no
labelled text with a letter); repeated rows get equal results; a null doc_id is not held out and not learned from; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

WINDOW = 64
LANES = 2048
LETTER = regex.compile(r"\p{L}")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_LETTER = np.zeros(256, np.float32)
IS_LETTER[97:123] = 1
IS_LETTER[128:] = 1


@dataclass
class Network:
    """tables: input of the update gate, the reset gate and the candidate for each byte (3H x 256), by direction; own: their
    recurrent weights (3H x H); bias: of the candidate's recurrent part; out: languages x 2H; shift: languages."""

    langs: list[str]
    tables: list[np.ndarray]
    own: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [*self.tables, *self.own, *self.bias, self.out, self.shift]


def fresh(langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
    draw = lambda *size, by: (rng.standard_normal(size) * by).astype(np.float32)
    return Network(
        langs, [draw(3 * hidden, 256, by=0.3) for _ in "fb"], [draw(3 * hidden, hidden, by=hidden**-0.5) for _ in "fb"],
        [np.zeros((hidden, 1), np.float32) for _ in "fb"], draw(len(langs), 2 * hidden, by=0.3), np.zeros((len(langs), 1), np.float32),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def gradients(net: Network, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the letters' positions of windows (bytes: positions x windows), and its gradients."""
    steps, lanes = data.shape
    h = net.own[0].shape[1]
    kept, states = [], []
    for d in range(2):
        state, cache, out = np.zeros((h, lanes), np.float32), [], np.empty((steps, h, lanes), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, u = net.tables[d][:, data[t]], net.own[d] @ state
            gates = sigmoid(x[: 2 * h] + u[: 2 * h])
            z, r, inner = gates[:h], gates[h:], u[2 * h :] + net.bias[d]
            n = np.tanh(x[2 * h :] + r * inner)
            cache.append((t, state, z, r, inner, n))
            state = n + z * (state - n)
            out[t] = state
        kept.append(cache)
        states.append(out)
    both = np.concatenate(states, axis=1)
    logits = np.matmul(net.out, both) + net.shift
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    weight = IS_LETTER[data]
    weight = weight / max(weight.sum(), 1)
    lane = np.arange(lanes)
    loss = float(-(np.log(p[:, label, lane] + 1e-12) * weight).sum())
    p[:, label, lane] -= 1
    p *= weight[:, None, :]
    d_out = np.einsum("tkb,thb->kh", p, both, optimize=True)
    d_both = np.matmul(net.out.T, p)
    tables, own, bias = [], [], []
    for d in range(2):
        back, d_own, d_bias = np.zeros((h, lanes), np.float32), np.zeros_like(net.own[d]), np.zeros_like(net.bias[d])
        d_in = np.empty((steps, 3 * h, lanes), np.float32)
        for t, state, z, r, inner, n in reversed(kept[d]):
            back = back + d_both[t, d * h : (d + 1) * h]
            d_n = back * (1 - z) * (1 - n * n)
            d_in[t, :h] = back * (state - n) * z * (1 - z)
            d_in[t, h : 2 * h] = d_n * inner * r * (1 - r)
            d_in[t, 2 * h :] = d_n
            up = d_in[t].copy()
            up[2 * h :] *= r
            d_own += up @ state.T
            d_bias += up[2 * h :].sum(axis=1, keepdims=True)
            back = back * z + net.own[d].T @ up
        flat, index = d_in.transpose(1, 0, 2).reshape(3 * h, -1), data.ravel()
        tables.append(np.stack([np.bincount(index, row, 256) for row in flat]).astype(np.float32))
        own.append(d_own)
        bias.append(d_bias)
    return loss, [*tables, *own, *bias, d_out, p.sum(axis=(0, 2))[:, None]]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], *, hidden: int = 8, steps: int = 350, lanes: int = 192, rate: float = 0.02, seed: int = 7) -> Network:
    """windows: examples x WINDOW bytes; labels: places in langs. Adam, with as many examples of every language in a step."""
    rng = np.random.default_rng(seed)
    net = fresh(langs, hidden, rng)
    by = [np.flatnonzero(labels == k) for k in range(len(langs))]
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        kind = rng.integers(0, len(langs), lanes)
        pick = np.array([by[k][rng.integers(len(by[k]))] for k in kind])
        _, grads = gradients(net, np.ascontiguousarray(windows[pick].T), kind)
        scale = min(1.0, 1.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
        now = rate * (1 - step / (steps + 1)) + 1e-4
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


class Reader:
    """Prediction with buffers that are used again and again; gates' inputs are halved beforehand, so a sigmoid is one tanh."""

    def __init__(self, net: Network) -> None:
        h = self.h = net.own[0].shape[1]
        half = np.concatenate([np.full(2 * h, 0.5, np.float32), np.ones(h, np.float32)])[:, None]
        self.net, self.k = net, len(net.langs)
        self.tables, self.own = [np.ascontiguousarray(x * half) for x in net.tables], [x * half for x in net.own]
        self.out = [np.ascontiguousarray(net.out[:, :h]), np.ascontiguousarray(net.out[:, h:])]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities over each window's letters, languages x windows; data: positions x windows."""
        steps, lanes = data.shape
        h, k = self.h, self.k
        logits = np.empty((steps, k, lanes), np.float32)
        x, u, gate, n = (np.empty((rows, lanes), np.float32) for rows in (3 * h, 3 * h, 2 * h, h))
        for d in range(2):
            state = np.zeros((h, lanes), np.float32)
            table, own, bias, out = self.tables[d], self.own[d], self.net.bias[d], self.out[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(table, data[t], axis=1, out=x, mode="clip")
                np.matmul(own, state, out=u)
                np.add(x[: 2 * h], u[: 2 * h], out=gate)
                np.tanh(gate, out=gate)
                gate *= 0.5
                gate += 0.5
                np.add(u[2 * h :], bias, out=n)
                n *= gate[h:]
                n += x[2 * h :]
                np.tanh(n, out=n)
                state -= n
                state *= gate[:h]
                state += n
                if d == 0:
                    np.matmul(out, state, out=logits[t])
                else:
                    logits[t] += out @ state
        logits += self.net.shift
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (IS_LETTER[data] / logits.sum(axis=1))[:, None, :]
        return logits.sum(axis=0)

    def texts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pooled probabilities, texts x languages; raw: the bytes of all texts, at: where each begins."""
        raw = FOLD[raw]
        n = -(-np.diff(at) // WINDOW)
        owner = np.repeat(np.arange(len(n)), n)
        begin = at[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        end = at[owner + 1]
        pooled, seen = np.zeros((self.k, len(n))), np.zeros(len(n))
        lanes = max(1, LANES * 64 // max(64, self.k))  # as much memory for any number of languages
        for lo in range(0, len(owner), lanes):
            place = begin[lo : lo + lanes] + np.arange(WINDOW)[:, None]
            data = np.where(place < end[lo : lo + lanes], raw[np.minimum(place, len(raw) - 1)], 0)
            got = self.windows(data)
            who = owner[lo : lo + lanes]
            seen += np.bincount(who, IS_LETTER[data].sum(axis=0), len(n))
            for k in range(self.k):
                pooled[k] += np.bincount(who, got[k], len(n))
        return (pooled / np.maximum(seen, 1)).T


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.expr(f"crc32(cast(cast(`{id_col}` as string) as binary)) % 4 = 2"), F.lit(False))


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    per_lang: int = 400, per_text: int = 12, **training,
) -> Network | None:
    """Train on windows of labelled texts; None if no text with a language has a letter.

    The sample is bounded: about per_lang texts of each language, however rare, chosen by a hash of the id,
    and per_text windows of each, at places that a hash chooses. No more than these windows reach the driver."""
    rows = labelled.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    picked = rows.where((F.expr("pmod(xxhash64(doc_id, 'pick'), 1048576)") / 1048576) < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    window = f"substring(text, cast(1 + pmod(xxhash64(doc_id, i), greatest(length(text) - {WINDOW}, 1)) as int), {WINDOW})"
    cut = picked.select("lang", "doc_id", F.expr(f"transform(sequence(1, {per_text}), i -> {window})").alias("cut"))
    sample = cut.orderBy(F.expr("xxhash64(doc_id, 'order')"), "doc_id", "lang", "cut").limit(2 * per_lang * len(counts)).collect()
    seen: dict[str, list[bytes]] = {}
    for r in sample:
        for text in r["cut"]:
            if LETTER.search(text):
                seen.setdefault(r["lang"], []).append(text.encode("utf-8", "replace")[:WINDOW].ljust(WINDOW, b"\0"))
    langs = sorted(seen)
    if not langs:
        return None
    data = np.concatenate([np.frombuffer(b"".join(seen[x]), np.uint8) for x in langs]).reshape(-1, WINDOW)
    return train(FOLD[data], np.repeat(np.arange(len(langs)), [len(seen[x]) for x in langs]), langs, **training)


def judged(reader: Reader | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch."""
    known = np.array([bool(x.is_valid and LETTER.search(x.as_py())) for x in texts], bool)
    if reader is None or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts))
    pooled = reader.texts(*C.text_bytes(texts))
    best = pooled.argmax(axis=1)
    score = np.where(known, np.clip(pooled[np.arange(len(best)), best], 0, 1), 0.0)
    return [reader.net.langs[b] if ok else "und" for b, ok in zip(best, known)], score


def keep(docs: DataFrame, net: Network | None, text_col: str = "text", *, min_score: float = 0.4) -> DataFrame:
    """The rows, all columns as they are, whose text has a language and whose best one gets min_score at least. A map over rows."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            langs, score = judged(reader, batch.column(place))
            yield batch.filter(pa.array(np.array([lang != "und" for lang in langs], bool) & (score >= min_score)))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, one row per input row. A map over rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            langs, score = judged(reader, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_recurrent_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    net = fit(docs.where(~is_held_out()))
    return predict(docs, net).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
