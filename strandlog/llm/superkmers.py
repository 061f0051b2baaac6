"""Substring deduplication over word windows by super-k-mer partitioning.

The minimiser of a window is the first of the smallest hashes among its runs of `seed_words` words; consecutive windows that
share that run, at its place, make a super-k-mer, which travels as one packed string to the bucket of its minimiser. There the strings are sorted
by where they stand and cut into windows, so each bucket finds exactly which windows also start earlier.

A minimiser that the corpus has once has no repeated window, so a first pass counts minimisers (eight bytes each, summed
before the shuffle) and only super-k-mers of repeated ones are packed and sent. Texts that are copies of an earlier document's
whole text lose all their windows and send nothing. Equal strings are recognised whole, so a
bucket holds the distinct strings of one minimiser and cuts only those. Windows are compared as text; whole texts that copy an
earlier one are told by 128 bits of hash.

Defined results: null, empty and blank texts have no words; rows are told apart by doc_id and text, so equal rows get equal
results and remove nothing from each other; rows of one doc_id with different texts count as one document, whose earlier
start wins, and at equal starts none; a null doc_id comes before all others; texts of any length are handled whole; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

ALL = 1 << 30
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def super_kmers(items: pa.Array, at: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, ...]:
    """For the words of some texts: row, first window, number of windows and minimiser of each super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(items) < window:
        return none, none, none, none
    coded = items.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word = own[np.asarray(coded.indices)]
    n = len(word) - seed_words + 1
    runs = np.zeros(n, np.uint64)
    for i in range(seed_words):
        runs = mixed(runs * ODD + word[i : i + n])
    span = window - seed_words + 1  # runs in a window
    low, place, have = runs, np.arange(n), 1
    while have < span:  # the smallest of `span` in a row and its first place, by doubling
        step = min(have, span - have)
        later = low[step:] < low[: len(low) - step]
        low, place = np.where(later, low[step:], low[: len(low) - step]), np.where(later, place[step:], place[: len(place) - step])
        have += step
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
    if not len(row):
        return none, none, none, none
    count = np.maximum(n - window + 1, 0)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    low, place = low[at[row] + begin], place[at[row] + begin]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(place) != 0))))
    return row[first], begin[first], np.diff(np.append(first, len(row))), low[first].view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k and t name a row: its doc_id (null: the smallest number) and the hash of its text; h is one number for both."""
    rows = docs.select(C.doc_key(id_col).alias("k"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    return rows.select(F.xxhash64("k", "t").alias("h"), "k", "t", "text")


def minimisers(rows: DataFrame, window: int, seed_words: int) -> DataFrame:
    """h, s, n, m: row, first window, number of windows and minimiser of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in C.chunks(C.text_bytes(batch.column(1))[1], 8_000_000):
                row, begin, n, low = super_kmers(*C.words(batch.column(1).slice(lo, hi - lo)), window, seed_words)
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(low)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "s", "n", "m"])

    return rows.select("h", "text").mapInArrow(run, "h long, s int, n int, m long")


def packed(rows: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The chosen super-k-mers of each row as strings: their words, joined by one space.

    A string that the row already has starts earlier there, so it goes without words, adjoining ones as one, and not to the
    bucket: a text that repeats one word over and over sends one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in C.chunks(C.text_bytes(batch.column(2))[1], 4_000_000):
                out: list[tuple] = []
                for k, t, whole, places in zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(4))):
                    tokens, seen, again = (whole or "").encode("utf-8").split(), set(), None
                    for s, n, m in sorted((p["s"], p["n"], p["m"]) for p in places):
                        n = min(n, len(tokens) - window + 1 - s)
                        if n <= 0:  # places of another row with the same h
                            continue
                        words = b" ".join(tokens[s : s + n + window - 1])
                        if words not in seen:
                            seen.add(words)
                            out.append((k, t, s, n, m, words))
                        elif again and again[0] + again[1] == s:
                            again = (again[0], again[1] + n)
                        else:
                            out += [(k, t, *again, t ^ again[0], b"")] if again else []
                            again = (s, n)
                    out += [(k, t, *again, t ^ again[0], b"")] if again else []
                columns = zip(*out) if out else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names=["k", "t", "s", "n", "m", "words"])

    places = chosen.groupBy("h").agg(F.collect_set(F.struct("s", "n", "m")).alias("places"))
    return rows.join(places, "h").select("k", "t", "text", "places").mapInArrow(run, "k long, t long, s int, n int, m long, words binary")


def earlier_windows(strings: DataFrame, window: int) -> DataFrame:
    """Runs (k, t, s, n) of windows that also start earlier, found bucket by bucket in sorted order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, whole, seen = None, {}, {}
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for m, k, s, t, n, words in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if not words:
                    out.append((k, t, s, n))
                    continue
                if m != bucket:
                    bucket, whole, seen = m, {}, {}
                if (first := whole.setdefault(words, (k, s))) < (k, s):
                    out.append((k, t, s, n))
                    continue
                tokens, begun = words.split(b" "), None
                for i in range(n + 1):
                    if i < n and seen.setdefault(b" ".join(tokens[i : i + window]), (k, s + i)) < (k, s + i):
                        begun = i if begun is None else begun
                    elif begun is not None:
                        out.append((k, t, s + begun, i - begun))
                        begun = None
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k", "t", "s", "n"])

    n = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.select("m", "k", "s", "t", "n", "words").repartition(n, "m").sortWithinPartitions("m", "k", "s")
    return dealt.mapInArrow(run, "k long, t long, s int, n int")


def copies(rows: DataFrame) -> DataFrame:
    """h, k, t of the rows whose whole text (128 bits of hash) stands at a smaller k."""
    ids = rows.select("h", "k", "t", F.xxhash64(F.lit("copy"), "text").alias("u"))
    first = ids.groupBy("t", "u").agg(F.min("k").alias("first"))
    return C.written(ids.join(first, ["t", "u"]).where("k > first").select("h", "k", "t").distinct(), "copies")


def repeated_windows(rows: DataFrame, *, window: int = 20, seed_words: int = 8) -> DataFrame:
    """Runs (k, t, s, n): the n windows of row (k, t) that start at words s, s + 1, ... also start earlier."""
    found = minimisers(rows, window, seed_words)
    repeated = C.written(found.groupBy("m").count().where("count > 1").select("m"), "minimisers")
    copied = copies(rows)
    chosen = found.join(repeated, "m", "left_semi").join(copied.select("h"), "h", "left_anti")
    whole = copied.select("k", "t", F.lit(0).alias("s"), F.lit(ALL).alias("n"))
    return earlier_windows(packed(rows, chosen, window), window).union(whole)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 20, seed_words: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space), one row per input row.

    Both joins with the texts use one exchange of them by row."""
    rows = keyed(docs, id_col, text_col)
    cuts = repeated_windows(rows, window=window, seed_words=seed_words)
    cuts = cuts.groupBy(F.xxhash64("k", "t").alias("h")).agg(F.collect_set(F.struct("k", "t", "s", "n")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in C.chunks(C.text_bytes(batch.column(2))[1], 8_000_000):
                ids, kept, n_words, n_removed = [], [], [], []
                for k, t, text, spans in zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(4))):
                    tokens = (text or "").encode("utf-8").split()
                    ids.append(None if k == C.NULL_ID else k)
                    n_words.append(len(tokens))
                    spans = [x for x in spans or () if x["k"] == k and x["t"] == t]
                    if spans and len(tokens) >= window:
                        gone = np.zeros(len(tokens) + 1, np.int64)
                        for x in spans:
                            gone[x["s"]] += 1
                            gone[min(x["s"] + x["n"] + window - 1, len(tokens))] -= 1
                        tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                    n_removed.append(n_words[-1] - len(tokens))
                    kept.append(b" ".join(tokens).decode("utf-8"))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(cuts, "h", "left").select("k", "t", "text", "cuts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(C.load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS k, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
),
places AS (SELECT r, k, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
windows AS (
  SELECT r, k, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS run
  FROM places QUALIFY i + 19 <= n
),
first AS (SELECT run, min({'k': k, 'i': i}) AS f FROM windows GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM windows JOIN first USING (run) WHERE {'k': k, 'i': i} > f),
cut AS (
  SELECT r, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS kept
  FROM places LEFT JOIN gone g USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
