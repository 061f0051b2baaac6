"""SimHash near-duplicates found with covering locality-sensitive hashing.

Every bit of a fingerprint gets a nonzero vector of GF(2)^(r+1); table v (any nonzero vector) keeps the bits whose
vector has odd product with v. Up to r differing bits are r equations in r + 1 unknowns, so some v keeps none of
them: every pair within the radius meets in one of the 2^(r+1) - 1 tables, with no miss.

Equal fingerprints collapse before the tables are built, so a table holds distinct fingerprints only; inside a
bucket a task finds the connected parts and sends one edge per fingerprint, never all pairs. The edges become
components by rounds of large-star and small-star on DataFrames, each round cut by a written table.

Defined results: null, empty and blank texts have no word and fingerprint zero, which is linked like any other;
repeated rows get equal results; a null doc_id is never a component_id unless a component has no other; texts are
read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
DIRECT = 4096


def shingles(text: str | None, size: int, seed: int) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens), lambda a, b: a + b + 1))
    n = max(1, len(tokens) - size + 1)
    begins = [0, *(x + 1 for x in ends[: n - 1])]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], seed) for a, b in zip(begins, ends[min(size, len(tokens)) - 1 :])), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as an unsigned number; zero without hashes."""
    n = len(hashes)
    places = hashes.view(np.uint8).reshape(n, 8).astype(np.int64)
    places += np.arange(0, 2048, 256)
    ones = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * ones > n).ravel(), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as an unsigned number."""
    return majority(shingles(text, size, seed))


def two_fingerprints(text: str | None, size: int, seed: int = 42) -> tuple[int, int]:
    """The SimHash and a second one, of the same shingles' hashes mixed anew: as good as independent bits."""
    hashes = shingles(text, size, seed)
    mixed = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(hashes), majority(mixed ^ (mixed >> np.uint64(31)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, seed: int = 42, hashed: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's bit pattern as a long), one row per input row; hashed: also t, the text's hash."""
    more = ["t"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py(), size, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text", *[f"xxhash64(`{text_col}`) {x}" for x in more])
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {x} long" for x in more))


def masks(radius: int) -> list[int]:
    """The covering family: 2^(radius+1) - 1 masks of 64 bits; any `radius` bits are all absent from one of them.

    With fewer vectors than bits all are used in turn; else those whose first coordinate is one, so that every mask keeps 32 bits
    (one keeps all): any other choice has weaker masks, whose buckets are larger."""
    top = 1 << (radius + 1)
    half = top >> 1
    vectors = [i % (top - 1) + 1 for i in range(64)] if top <= 64 else [half + (i * 37 + (i >> 1)) % half if half > 64 else half + i for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts(values: np.ndarray, radius: int) -> np.ndarray:
    """The index of the first member of each value's connected part, values linked within the radius.

    Up to DIRECT values are compared by a search that drops what it has reached. More are first joined through the
    one-bit neighbours that they share (all pairs within 2 bits), then what isn't in the largest part is compared with all."""
    n = len(values)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)

    if n <= DIRECT:
        left = np.arange(n)
        while len(left):
            first, front = left[0], [left[0]]
            left = left[1:]
            while front and len(left):
                near = np.bitwise_count(values[left] ^ values[front.pop()]) <= radius
                front += (got := left[near]).tolist()
                root[got] = first
                left = left[~near]
        return root
    if radius >= 2:
        differ = int(np.bitwise_or.reduce(values ^ values[0]))
        flips = [0] + [1 << b for b in range(64) if differ >> b & 1]
        key = np.concatenate([values ^ np.uint64(x) for x in flips])
        by = np.argsort(key, kind="stable")
        owner, same = by % n, np.flatnonzero(key[by][1:] == key[by][:-1])
        for i, j in zip(owner[same].tolist(), owner[same + 1].tolist()):
            join(i, j)
    top = np.array([find(i) for i in range(n)])
    for i in np.flatnonzero(top != np.bincount(top).argmax()).tolist():
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            join(i, j)
    return np.array([find(i) for i in range(n)])


def whole_buckets(batches: Iterator[pa.RecordBatch], bucket: Callable, skip: int) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]]]]:
    """Sorted batches of long columns as runs of whole buckets: the columns from `skip` on, and the places of buckets of two rows or more.

    bucket(*columns) gives two arrays that name each row's bucket. One over several batches is put together once, at its end."""
    held: list[list[np.ndarray]] = []

    def cut(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
        v, key = bucket(*columns)
        edge = np.flatnonzero(np.concatenate(([True], (np.diff(v) != 0) | (np.diff(key) != 0))))
        ends = np.append(edge[1:], len(v))
        many = ends - edge > 1
        return columns[skip:], list(zip(edge[many].tolist(), ends[many].tolist()))

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(x).astype(np.int64) for x in batch.columns]
        v, key = bucket(*now)
        whole = int(np.flatnonzero((v != v[-1]) | (key != key[-1])).max(initial=-1)) + 1
        if held and not whole and last == (v[0], key[0]):
            held.append(now)
            continue
        done = [np.concatenate(x) for x in zip(*held, [x[:whole] for x in now])]
        if len(done[0]):
            yield cut(done)
        held, last = [[x[whole:] for x in now]], (v[-1], key[-1])
    if held:
        yield cut([np.concatenate(x) for x in zip(*held)])


def bucket_edges(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b), a > b, that connect all distinct fingerprints `fp` within the radius; one per fingerprint and table."""
    keys = F.explode(F.array(*[F.struct(F.lit(v).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(masks(radius))]))
    rows = distinct.select("fp", keys.alias("at")).select("at.v", "at.key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp,), cuts in whole_buckets(batches, lambda v, key, fp: (v, key), 2):
            out = []
            for lo, hi in cuts:
                values = np.sort(fp[lo:hi])
                top = parts(values.view(np.uint64), radius)
                moved = np.flatnonzero(top != np.arange(len(top)))
                out.append(np.stack([values[moved], values[top[moved]]]))
            if out:
                both = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "v", "key").sortWithinPartitions("v", "key").mapInArrow(run, "a long, b long").distinct()


def pair_parts(x: np.ndarray, y: np.ndarray, radius: int, total: int) -> np.ndarray:
    """The index of the first member of each row's connected part; rows link where x differs in `radius` bits at most, x and y
    together in `total`. A search that drops what it has reached: a dense group ends after few steps."""
    root, left = np.arange(len(x)), np.arange(len(x))
    while len(left):
        first, front = left[0], [left[0]]
        left = left[1:]
        while front and len(left):
            i = front.pop()
            one = np.bitwise_count(x[left] ^ x[i])
            near = (one <= radius) & (one.astype(np.int64) + np.bitwise_count(y[left] ^ y[i]) <= total)
            front += (got := left[near]).tolist()
            root[got] = first
            left = left[~near]
    return root


def pair_edges(distinct: DataFrame, radius: int, total: int) -> DataFrame:
    """Edges (a, b) between the hashes of distinct pairs (p, q) of fingerprints, that connect all pairs of which p or q differs
    in `radius` bits at most and both together in `total`. Both fingerprints have their own tables."""
    kept = np.array([_signed(m) for m in masks(radius)], np.int64)
    tables = len(kept)
    rows = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(2 * tables - 1))).alias("v"), "p", "q")
    rows = rows.selectExpr("v", f"if(v < {tables}, p, q) x", f"if(v < {tables}, q, p) y")
    key = F.col("x").bitwiseAND(F.element_at(F.lit(kept.tolist()), F.col("v") % tables + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (v, x, y), cuts in whole_buckets(batches, lambda v, x, y: (v, x & kept[v % tables]), 0):
            out = []
            for lo, hi in cuts:
                top = pair_parts(x[lo:hi].view(np.uint64), y[lo:hi].view(np.uint64), radius, total)
                moved = np.flatnonzero(top != np.arange(hi - lo))
                ends = [x[lo + moved], y[lo + moved], x[lo + top[moved]], y[lo + top[moved]]]
                out.append(np.stack(ends if v[lo] < tables else [ends[i] for i in (1, 0, 3, 2)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in np.concatenate(out, axis=1)], names=["ap", "aq", "bp", "bq"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "v", key).sortWithinPartitions("v", key).mapInArrow(run, "ap long, aq long, bp long, bq long")
    return found.select(F.xxhash64("ap", "aq").alias("a"), F.xxhash64("bp", "bq").alias("b")).distinct()


def connected(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root (the smallest node that it reaches) for every node of the edges (a, b), by alternating large and small stars."""
    now, seen = C.written(edges.select("a", "b").where("a <> b").distinct(), name), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        now = C.written(small, name)
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if state == seen:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = state


def components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """For rows (doc_id, fp): one row per distinct fp with component_id, the smallest doc_id that it reaches, and root, the
    smallest fp that it reaches, which also tells components without any doc_id apart."""
    own = C.written(fps.groupBy("fp").agg(F.min("doc_id").alias("own")), "fingerprints")
    roots = connected(bucket_edges(own.select("fp"), radius))
    stars = roots.union(roots.select("root", "root").distinct()).toDF("fp", "root")
    least = stars.join(own, "fp").groupBy("root").agg(F.min("own").alias("least"))
    linked = stars.join(least, "root").select("fp", "root", "least")
    return C.written(own.join(linked, "fp", "left").select("fp", F.coalesce("least", "own").alias("component_id"), F.coalesce("root", "fp").alias("root")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per input row."""
    fps = C.written(fingerprints(docs, id_col, text_col, size=size, seed=seed), "simhash")
    found = fps.join(components(fps, radius), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted(docs: DataFrame, id_col: str, text_col: str, *, size: int, radius: int, total: int, seed: int) -> DataFrame:
    """doc_id, t (the text's hash) and root (the same for all of a component), linked by two fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([two_fingerprints(x.as_py(), size, seed) for x in batch.column(1)], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["doc_id", "t", "p", "q"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text", f"xxhash64(`{text_col}`) t")
    fps = C.written(rows.mapInArrow(run, "doc_id long, t long, p long, q long"), "simhash")
    roots = connected(pair_edges(fps.select("p", "q").distinct(), radius, total))
    named = fps.withColumn("node", F.xxhash64("p", "q")).join(roots, "node", "left")
    return named.select("doc_id", "t", F.coalesce("root", "node").alias("root"))


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 4, radius: int = 4, total: int | None = None, seed: int = 42
) -> DataFrame:
    """One document of each component, all columns as they were: that of the smallest doc_id (null after all others), of its
    texts the one of the smallest hash. Only rows of one doc_id and one text collapse, to one row.

    Without total, fingerprints link within the radius. With it texts have two fingerprints; they link where either is within
    the radius and both together differ in `total` bits at most: fewer pairs are missed, and a chance partner of one fingerprint
    is told by the other."""
    _key, _text, _rank = "__simhash_key", "__simhash_text", "__simhash_rank"
    if total is None:
        fps = C.written(fingerprints(docs, id_col, text_col, size=size, seed=seed, hashed=True), "simhash")
        found = fps.join(components(fps, radius).select("fp", "root"), "fp")
    else:
        found = rooted(docs, id_col, text_col, size=size, radius=radius, total=total, seed=seed)
    one = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("one"))
    stay = one.select(C.doc_key("one.doc_id").alias(_key), F.col("one.t").alias(_text))
    kept = docs.withColumns({_key: C.doc_key(id_col), _text: F.xxhash64(F.col(text_col))}).join(stay, [_key, _text], "left_semi")
    rank = F.expr(f"row_number() over (partition by `{_key}`, `{_text}` order by `{_key}`)")
    return kept.withColumn(_rank, rank).where(f"{_rank} = 1").select(*docs.columns)


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.load(spark, sf_dir, "documents"))
