"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every k-gram of words is hashed; of w in a row the smallest hash is kept as a fingerprint. With k + w - 1 equal to the span of
interest (8 words), two texts that share such a span share a fingerprint inside it, so joining the fingerprints misses none. A
hit gives alignments of document and item; each is extended over the words around the fingerprint by comparing the words
themselves, which yields the exact occurrences of the item's windows. Items of fewer words than the span are one window; their
fingerprint is their first k-gram or, of fewer than k words, themselves, and runs of that size are all kept in the documents.

Item windows come from the benchmark, a stated set; its fingerprints are broadcast only if they were counted or measured, else
the join is a shuffled one, each hash dealt to several tasks. Only documents that share a fingerprint are compared by words.

Defined results: null, empty and wordless texts have no words and no hit; an item without words never occurs; items are told
apart by item_id, and rows of one item_id are its windows together; rows of documents are told apart by doc_id and text, so
repeated rows get equal results; a null doc_id is a document like others, a null item_id is no item; texts are read whole;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def word_array(text: str) -> Column:
    """Lower-cased (A-Z) runs of digits, ASCII letters and everything beyond ASCII; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower()), BETWEEN), "")


def folded_words(text: str) -> Column:
    """As many words at the same places, all letters in lower case: equal words stay equal, and it is faster than word_array.

    Lower case depends on neighbours or the locale for two letters; each becomes one form."""
    low = F.replace(F.replace(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("\u03c2"), F.lit("\u03c3")), F.lit("\u0131"), F.lit("i"))
    return F.array_remove(F.split(low, BETWEEN), "")


def one(array: Column, name: str) -> Column:
    """The generator of one row keeps Catalyst from computing an array anew at each use."""
    return F.explode(F.array(array)).alias(name)


def _bound(lets: dict[str, str], body: str) -> str:
    """SQL for `body` with named arrays, each computed once."""
    for name, value in reversed(lets.items()):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


def _grams(sizes: set[int], words: str) -> dict[str, str]:
    """g<k>: the hash of each run of k words, for each k of sizes and what they are made of: a word is hashed once, a run from two shorter ones."""
    lets = {"g1": f"transform({words}, x -> xxhash64(x))"}

    def make(k: int) -> None:
        if f"g{k}" not in lets:
            half = 1 << ((k - 1).bit_length() - 1)
            make(half)
            make(k - half)
            lets[f"g{k}"] = f"slice(zip_with(g{half}, slice(g{k - half}, {half + 1}, size({words})), (x, y) -> xxhash64(x, y)), 1, greatest(size({words}) - {k - 1}, 0))"

    for k in sorted(sizes):
        make(k)
    return lets


def _least(k: int, w: int, words: str) -> dict[str, str]:
    """least: of every w runs of k words in a row the smallest hash, by doubling."""
    have, name, lets = 1, f"g{k}", {}
    while have < w:
        step = min(have, w - have)
        lets[f"m{have + step}"] = f"zip_with({name}, slice({name}, {step + 1}, size({words})), (x, y) -> least(x, y))"
        have, name = have + step, f"m{have + step}"
    return lets | {"least": f"slice({name}, 1, greatest(size({words}) - {k + w - 2}, 0))"}


def fingerprints(words: str, k: int, w: int, whole: Iterable[int] = ()) -> Column:
    """The distinct hashes that winnowing keeps of an array of words - in every w runs of k words in a row, the smallest - and the
    hashes of all runs of the sizes in `whole`."""
    lets = _grams({k, *whole}, words) | _least(k, w, words)
    return F.expr(_bound(lets, f"array_distinct(concat(least, {', '.join(f'g{n}' for n in sorted(whole)) or 'array()'}))"))


def runs(words: str, sizes: Iterable[int]) -> Column:
    """(size, hash) of every run, by size, then place."""
    sizes = sorted(sizes)
    return F.expr(_bound(_grams(set(sizes), words), f"array({', '.join(f'struct({n} as size, g{n} as hashes)' for n in sizes)})"))


#: A window of the neighbourhood occurs if all its words agree with those at its place; `here` begins at greatest(begin, 0).
AGREE = (
    "filter(transform(if(greatest(0, -begin) <= size(near) - length, sequence(greatest(0, -begin), size(near) - length), array()), i -> if("
    "slice(near, i + 1, length) = slice(here, i + 1 + least(begin, 0), length), struct(begin + i as begin, length), null)), y -> y is not null)"
)
HERE = "slice(words, greatest(begin, 0) + 1, greatest(size(near) + least(begin, 0), 0)) as here"


def placed(rows: DataFrame, keep: list[str], sizes: Iterable[int]) -> DataFrame:
    """The rows' columns `keep`, and size, place (from 0) and hash of every run of `folded` words."""
    by = rows.select(*keep, F.explode(runs("folded", sizes)).alias("r"))
    return by.select(*keep, "r.size", F.posexplode("r.hashes").alias("place", "hash"))


def item_fingerprints(items: DataFrame, span: int, k: int) -> DataFrame:
    """size, hash, item_id, lead, near, length: an item's fingerprints - those that winnowing keeps or, of an item shorter than the
    span, its first run of k words or, if it has fewer, itself. near: the words that windows around it can hold; lead: how many of
    them stand before it; length: the words of a window."""
    around = span - k
    long, short = items.where(f"size(words) >= {span}"), items.where(f"size(words) < {span}")
    kept = long.select("row", F.explode(fingerprints("folded", k, around + 1)).alias("hash"))
    near = f"slice(words, greatest(place - {around}, 0) + 1, least(place, {around}) + {k + around}) as near"
    found = placed(long, ["row", "item_id", "words"], [k]).join(kept, ["row", "hash"]).selectExpr("size", "hash", "item_id", f"least(place, {around}) as lead", near, f"{span} as length")
    first = placed(short, ["item_id", "words"], range(1, k + 1)).where(f"place = 0 and size = least(size(words), {k})")
    return C.written(found.union(first.selectExpr("size", "hash", "item_id", "0", "words", "size(words)")).distinct(), "item_fingerprints")


def joined(ours: DataFrame, theirs: DataFrame, on: list[str], small: bool, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join with the fingerprints of items: broadcast if small, else shuffled, a hash's rows dealt to `salts` tasks."""
    if small:
        return ours.join(F.broadcast(theirs), on, how)
    theirs = theirs.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return ours.withColumn("__salt", F.pmod(F.xxhash64("k", "t"), F.lit(salts)).cast("int")).join(theirs, [*on, "__salt"], how).drop("__salt")


@dataclass(frozen=True)
class Found:
    """rows: k, t, n_words and the columns asked for, one per input row; windows: the distinct (k, t, item_id, begin, length) of
    item windows that occur, in words of the row."""

    rows: DataFrame
    windows: DataFrame


def matches(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", *,
    span: int = 8, k: int = 4, most_broadcast: int = 200_000, most_bytes: int = 16_000_000, most_keys: int = 1_000_000,
) -> Found:
    """Where items' windows occur. k names a row with t: the doc_id (null: the smallest number) and the hash of the text.

    One pass over the texts counts their words and takes their fingerprints; rows that share one with an item are picked by their
    keys, 16 bytes each, broadcast if there are at most most_keys, and only these are aligned with items and compared."""
    told = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    told = told.select("item_id", F.xxhash64("item_id", "text").alias("row"), one(word_array("text"), "words"), folded_words("text").alias("folded"))
    theirs = item_fingerprints(C.written(told.where("size(words) > 0"), "items"), span, k)
    short = {r["size"] for r in theirs.where(f"length < {span}").select("size").distinct().collect()}  # k numbers at most
    hashes = C.written(theirs.select("hash").distinct(), "item_hashes")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.doc_key(id_col).alias("k"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    prints = texts.select("doc_id", "k", "t", one(folded_words("text"), "folded")).select("doc_id", "k", "t", F.size("folded").cast("long").alias("n_words"), fingerprints("folded", k, span - k + 1, short).alias("prints"))
    rows = C.written(prints, "fingerprints")
    keys = joined(rows.select("k", "t", F.explode("prints").alias("hash")), hashes, ["hash"], hashes.count() <= most_broadcast, "left_semi").select("k", "t").distinct()
    keys = C.written(keys, "hit_rows")
    keys = F.broadcast(keys) if keys.count() <= most_keys else keys
    there = texts.select("k", "t", "text").join(keys, ["k", "t"], "left_semi").dropDuplicates(["k", "t"])
    there = C.written(there.select("k", "t", one(word_array("text"), "words"), folded_words("text").alias("folded")), "hit_words")

    bytes_ = theirs.agg(F.sum(F.expr("64 + aggregate(near, 0L, (a, x) -> a + octet_length(x) + 24)"))).first()[0] or 0
    met = joined(placed(there, ["k", "t"], {k} | short), theirs, ["size", "hash"], bytes_ <= most_bytes)
    met = met.selectExpr("k", "t", "item_id", "place - lead as begin", "near", "length").distinct()
    sure = met.join(there, ["k", "t"]).selectExpr("k", "t", "item_id", "begin", "near", "length", HERE).select("k", "t", "item_id", F.explode(F.expr(AGREE)).alias("w"))
    return Found(rows.drop("prints"), C.written(sure.select("k", "t", "item_id", "w.begin", "w.length").distinct(), "windows"))


def occurrences(docs: DataFrame, items: DataFrame, *columns: str, **options) -> DataFrame:
    """The distinct (k, t, item_id, begin, length) of item windows that occur."""
    return matches(docs, items, *columns, **options).windows


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_items: int = 2, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated: one row per input row."""
    found = matches(docs, items, id_col, text_col, **options)
    # both lists of a row are bounded, by its own words and by the number of items
    spans = found.windows.groupBy("k", "t").agg(F.collect_set(F.struct("begin", "length")).alias("spans"))
    n_hit = F.expr("size(array_distinct(flatten(transform(spans, x -> sequence(x.begin, x.begin + x.length - 1)))))")
    named = found.windows.groupBy("k", "t").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hit = spans.select("k", "t", n_hit.alias("n_hit")).join(named, ["k", "t"])
    return found.rows.join(hit, ["k", "t"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    ).withColumn("contaminated", F.col("n_items") >= least_items)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(len(w), 8) as n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from b where len(w) > 0)),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
hit as (select distinct doc_id, i, dw.n, item_id from dw join bw on dw.s = bw.s and dw.n = bw.n),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join places on d.doc_id = places.doc_id left join found on d.doc_id = found.doc_id
"""
