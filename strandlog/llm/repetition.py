"""Quality rule: repetition measured with a suffix array over words.

A suffix array of each text's words is built by prefix doubling; the ranks of every doubling are kept, so the
longest common prefix of neighbours follows by descending through them. A suffix repeats for as many words as the
larger of its two neighbouring common prefixes; those are the maximal repeats of the LCP intervals that hold it,
and the union of their spans is what the text repeats.

Defined results: null, empty and blank texts have no words, fail the base rule and are not kept; repeated rows get
equal results; a text of any length is handled whole; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import common as C

SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def longest_repeats(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every word, how many words from it on also occur elsewhere in its own text.

    codes: word numbers of all texts in a row; at: where each text begins."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    end = np.repeat(at[1:], np.diff(at))
    _, key = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * (int(codes.max()) + 1) + codes, return_inverse=True)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    group = np.repeat(first, np.diff(np.append(first, n)))
    rank = np.empty(n, np.int32)  # kept for every doubling
    rank[order] = group
    levels, k = [rank.copy()], 1
    slots = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))
    while len(slots):
        here = order[slots]
        there = here + k
        inside = there < end[here]
        follow = np.where(inside, levels[-1][np.minimum(there, n - 1)] + np.int64(1), 0)
        by = np.lexsort((follow, rank[here]))
        here, follow = here[by], follow[by]
        old = rank[here]
        new = np.concatenate(([True], (np.diff(old) != 0) | (np.diff(follow) != 0)))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(here)))
        order[slots] = here
        rank[here] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        levels.append(rank.copy())
        k *= 2
    lcp = np.zeros(n + 1, np.int64)  # lcp[s]: of the suffixes at s - 1 and s
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, got = a[same], b[same], np.zeros(len(same), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + got, b + got
        fits = (x < end[a]) & (y < end[b])
        fits[fits] = levels[level][x[fits]] == levels[level][y[fits]]
        got[fits] += 1 << level
    lcp[same + 1] = got
    out = np.empty(n, np.int64)
    out[order] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(length: np.ndarray, least: int, exact: bool = False) -> np.ndarray:
    """Which words lie in a repeat of `least` words or more; exact: in a repeated window of just `least` words."""
    n = len(length)
    at = np.flatnonzero(length >= least)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + (least if exact else length[at]), -1)
    return np.cumsum(delta[:-1]) > 0


def _columns(ids: pa.Array, texts: pa.Array, min_words: int, max_covered: float, max_longest: float) -> dict:
    items, at = C.words(texts)
    n_words = np.diff(at)
    raw, byte_at = C.text_bytes(texts)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    lines, row = C.pieces(pc.split_pattern(pc.fill_null(texts, ""), "\n"))
    full = np.asarray(pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0))
    row = row[full]
    line = np.asarray(lines.filter(pa.array(full)).dictionary_encode().indices).astype(np.int64)
    n_lines = np.bincount(row, minlength=len(texts))
    distinct = np.unique(row * (int(line.max(initial=0)) + 1) + line) // (int(line.max(initial=0)) + 1)
    codes = np.asarray(items.dictionary_encode().indices).astype(np.int64)
    repeat_words, cover, longest = (np.zeros(len(texts), np.int64) for _ in range(3))
    for lo, hi in C.chunks(at, 400_000):
        part = at[lo : hi + 1] - at[lo]
        length = longest_repeats(codes[at[lo] : at[hi]], part)
        repeat_words[lo:hi] = C.sums(covered(length, 3, exact=True), part)
        cover[lo:hi] = C.sums(covered(length, min_words), part)
        some = np.flatnonzero(np.diff(part))
        if len(some):
            longest[lo + some] = np.maximum.reduceat(length, part[some])
    failed = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    return {
        "doc_id": ids,
        "n_words": n_words,
        "word_chars": C.sums(np.asarray(pc.utf8_length(items)), at),
        "n_symbols": C.sums(is_symbol[raw], byte_at),
        "n_dup_lines": n_lines - np.bincount(distinct, minlength=len(texts)),
        "n_repeat_words": repeat_words,
        "covered_words": cover,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~failed & (cover <= max_covered * n_words) & (longest <= max_longest * n_words),
    }


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    min_words: int = 10, max_covered: float = 0.2, max_longest: float = 0.15,
) -> DataFrame:
    """One row per text with its counts and the verdict `kept`.

    min_words: shortest repeat that counts; max_covered: largest share of words inside repeats; max_longest: largest
    share of the text's words that the longest repeat may have. The two limits stand far out in the tails of texts that pass the
    base rule: about one in two hundred is beyond either. A map over rows: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _columns(batch.column(0), batch.column(1), min_words, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got.values()], names=list(got))

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.load(spark, sf_dir, "documents"))


#: The longest repeat by bisection: a text that repeats a run of m words repeats shorter ones too.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
places AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
runs AS (
  SELECT r, n, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS three,
    string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten
  FROM places
),
threes AS (SELECT r, i FROM runs WHERE i + 2 <= n QUALIFY count(*) OVER (PARTITION BY r, three) > 1),
tens AS (SELECT r, i FROM runs WHERE i + 9 <= n QUALIFY count(*) OVER (PARTITION BY r, ten) > 1),
in_threes AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 3)) AS i FROM threes) GROUP BY r),
in_tens AS (SELECT r, count(DISTINCT i) AS covered_words FROM (SELECT r, unnest(range(i, i + 10)) AS i FROM tens) GROUP BY r),
hashed AS (SELECT r, n, i, hash(word) AS h FROM places),
bounds AS (
  SELECT r, 0 AS lo, greatest(len(w), 1) AS hi FROM d
  UNION ALL
  SELECT r, if(count(*) > count(DISTINCT run), any_value(m), any_value(lo)), if(count(*) > count(DISTINCT run), any_value(hi), any_value(m))
  FROM (
    SELECT r, lo, hi, m, hash(list(h) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND m - 1 FOLLOWING)) AS run
    FROM (SELECT r, lo, hi, least(greatest(2 * lo, 1), (lo + hi) // 2) AS m FROM bounds WHERE hi - lo > 1) JOIN hashed USING (r)
    QUALIFY i + m - 1 <= n
  )
  GROUP BY r
),
longest AS (SELECT r, max(lo) AS longest_repeat FROM bounds GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, CAST(longest_repeat AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN lines USING (r) LEFT JOIN in_threes USING (r) LEFT JOIN in_tens USING (r) LEFT JOIN longest USING (r)
),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND covered_words <= 0.2::DOUBLE * n_words AND longest_repeat <= 0.15::DOUBLE * n_words AS kept FROM judged
"""
