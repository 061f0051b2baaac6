"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line (trimmed of ASCII blanks, not empty) goes if an equal line, or one at edit distance 1 (or up to `edits`) from it, occurs
earlier: by doc_id, then by place. Lines of all lengths are compared; `near_chars` can leave short ones to equality.

Equal lines meet by a 128-bit hash. For distance 1 every line would emit all its one-deletion variants as hashed keys; to emit
them only where a partner can be, the same idea first runs with whole blocks deleted: two lines at distance 1 agree in all but
one block, so they share the key of what is left of it. That is done with halves of a line, then with short blocks for the
lines that found a partner, then with single characters for the blocks that did. No step drops a pair.

Variants carry the deleted place: lines of one length that share a variant at one place differ there alone, and a line equal to a
longer one's variant is one insertion away. So all that meet at a key are within the bound, the earliest is read off each key by
one minimum, no pairs are formed, and groups of any size are exact. Each found pair's distance is then verified.

Defined results: a null text stays null with no lines; blank lines are never removed and count as lines; rows are told apart by
doc_id and text, so repeated rows get equal results and remove nothing from each other; of one doc_id's different texts the line
that stands first wins, then the smaller hash of the text; a null doc_id comes first; lines of any length are handled whole;
further columns are ignored or, in `clean`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

TRIMMED = "transform(split(text, '\\n'), x -> trim(BOTH ' \\t\\r\\u000B\\f' FROM x))"
#: Width of blocks for a line of n characters: halves, and blocks near the root of its length.
HALF = "(({n} + 1) div 2)"
SHORT = "shiftleft(1, greatest(4, (length(bin({n} - 1)) + 1) div 2))"


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, t, pos, line, n (characters), a and b (128 bits of hash) of every line that isn't blank."""
    rows = docs.select(C.doc_key(id_col).alias("k"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select("k", "t", F.posexplode_outer(F.expr(TRIMMED)).alias("pos", "line")).where("line <> ''")  # outer: else a filter that Catalyst adds computes the lines twice
    return lines.selectExpr("k", "t", "pos", "line", "length(line) as n", "xxhash64(line) as a", "xxhash64('b', line) as b")


def block_keys(width: str) -> Column:
    """(key, block, width, longer) for every block deleted: as a line of its own length, and as the shorter of two, whose partner
    has one character more in that block."""
    own, next_ = width.format(n="n"), width.format(n="(n + 1)")
    as_own = f"transform(array({own}), w -> transform(sequence(0, (n - 1) div w), i -> struct(xxhash64(n, i, left(line, i * w), substring(line, (i + 1) * w + 1)) as key, i as block, w as width, true as longer)))[0]"
    as_shorter = f"transform(array({next_}), w -> transform(sequence(0, n div w), i -> struct(xxhash64(n + 1, i, left(line, i * w), substring(line, (i + 1) * w)) as key, i as block, w as width, false as longer)))[0]"
    return F.explode_outer(F.expr(f"concat({as_own}, {as_shorter})"))  # never empty


def where_shared(keyed: DataFrame, most_broadcast: int) -> DataFrame:
    """The rows (at.key, a, ...) whose key stands at two lines or more. The keys are broadcast only if counted and few."""
    both = keyed.groupBy("at.key").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("key")
    both = C.written(both, "shared_keys")
    if both.count() <= most_broadcast:
        both = F.broadcast(both)
    return keyed.join(both, F.col("at.key") == both["key"], "left_semi")


def near_lines_within(lines: DataFrame, edits: int, near_chars: int, most_broadcast: int) -> DataFrame:
    """near_lines for any bound, by verified candidates. Of edits + 1 segments of a line one is whole in each line within the bound
    that is no shorter, moved by few places: keys are a line's segments and, of a line as the longer one, what stands
    where a shorter one's segments can be. Nothing is missed; a key's lines are compared in pairs, so time grows with large groups."""
    n_parts = edits + 1
    size = f"((i + 1) * m) div {n_parts} - (i * m) div {n_parts}"
    key = "xxhash64(m, i, substring(line, cast((i * m) div {0} + {1} + 1 as int), cast({2} as int)))"
    own = f"flatten(transform(array(n), m -> transform(sequence(0, {edits}), i -> {key.format(n_parts, 0, size)})))"
    # with i segments before and edits - i after it, a segment that is the first or last whole one moves by so much at most
    shifts = f"sequence(greatest(-i, n - m - ({edits} - i)), least(i, n - m + {edits} - i))"
    moved = f"filter({shifts}, d -> (i * m) div {n_parts} + d between 0 and n - ({size}))"
    as_longer = f"flatten(transform(sequence(greatest(n - {edits}, {near_chars}), n), m -> flatten(transform(sequence(0, {edits}), i -> transform({moved}, d -> {key.format(n_parts, 'd', size)})))))"
    sided = lambda keys, longer: f"transform(array_distinct({keys}), x -> struct(x as key, {longer} as longer))"
    at = F.explode_outer(F.expr(f"concat({sided(own, 'false')}, {sided(as_longer, 'true')})")).alias("at")
    # first the keys alone: what no other line has is dropped before any text moves
    keyed = lines.where(f"n >= {near_chars}").select("k", "t", "pos", "line", "n", "a", "b", at)
    met = keyed.groupBy("at.key").agg(F.min("a").alias("least"), F.max("a").alias("most"), F.max("at.longer").alias("longer"), F.min("at.longer").alias("own"))
    met = C.written(met.where("least <> most and longer and not own").select("key"), "shared_keys")
    met = F.broadcast(met) if met.count() <= most_broadcast else met
    shared = lambda rows: rows.join(met, F.col("at.key") == met["key"], "left_semi")
    one = shared(keyed).groupBy("a", "b").agg(F.min(F.struct("k", "pos", "t")).alias("first"), F.first("line").alias("line"), F.first("n").alias("n"))
    one = C.written(one, "segment_partners")
    both = C.written(shared(one.select("a", "line", "n", at)).select("a", "at.key", "at.longer"), "segments")
    pairs = both.where("longer").select("a", "key").join(both.where("not longer").select(F.col("a").alias("oa"), "key"), "key").where("a <> oa").select("a", "oa").distinct()
    other = one.select(F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("first").alias("other"), F.col("line").alias("other_line"))
    sure = pairs.join(one, "a").join(other, "oa").where(f"levenshtein(line, other_line, {edits}) between 1 and {edits}")
    gone = sure.select(F.expr("if(other < first, struct(a, b), struct(oa as a, ob as b))").alias("gone"), F.least("first", "other").alias("keep"))
    found = gone.groupBy("gone.a", "gone.b").agg(F.min("keep").alias("keep"))
    return C.written(found.selectExpr("a", "b", "keep.k as keep_k", "keep.pos as keep_pos"), "near_lines")


def near_lines(lines: DataFrame, *, near_chars: int = 1, most_broadcast: int = 500_000, edits: int = 1) -> DataFrame:
    """a, b of every line that has a line within `edits` whose first place is earlier; keep_k, keep_pos: that of the earliest."""
    if edits < 1:
        raise ValueError("edits must be 1 or more")
    if edits > 1:
        return near_lines_within(lines, edits, near_chars, most_broadcast)
    long = lines.where(f"n >= {near_chars}")
    some = where_shared(long.select("k", "t", "pos", "line", "n", "a", "b", block_keys(HALF).alias("at")), most_broadcast)
    some = some.groupBy("a", "b").agg(F.min(F.struct("k", "pos", "t")).alias("first"), F.first("line").alias("line"), F.first("n").alias("n"))
    some = C.written(some, "half_partners")
    held = C.written(where_shared(some.select("a", "b", "first", "line", "n", block_keys(SHORT).alias("at")), most_broadcast), "block_partners")
    # single deletions inside the block: place >= 0 for lines of one length, -1 for those a character apart
    mid = "substring(line, at.block * at.width + 1, at.width - if(at.longer, 0, 1))"
    deleted = "concat(left(mid, i), substring(mid, i + 2))"
    places = "sequence(0, length(mid) - 1)"
    variants = (
        f"if(at.longer, if(length(mid) > 0, concat(transform({places}, i -> struct(i as place, xxhash64(at.key, i, {deleted}) as v)), "
        f"array_distinct(transform({places}, i -> struct(-1 as place, xxhash64(at.key, -1, {deleted}) as v)))), array()), array(struct(-1 as place, xxhash64(at.key, -1, mid) as v)))"
    )
    parts = held.select("a", "b", "first", "at", F.explode(F.array(F.expr(mid))).alias("mid"))
    rows = parts.select("a", "b", "first", "at.longer", F.explode_outer(F.expr(variants)).alias("x")).where("x is not null").select("a", "b", "first", "longer", "x.place", "x.v")
    least = rows.groupBy("v", "place").agg(
        F.count("*").alias("m"), F.min("first").alias("any"), F.min(F.when(F.col("longer"), F.col("first"))).alias("of_longer"), F.min(F.when(~F.col("longer"), F.col("first"))).alias("of_shorter"),
    ).where("m > 1")
    keep = F.when(F.col("place") >= 0, F.col("any")).when(F.col("longer"), F.col("of_shorter")).otherwise(F.col("of_longer"))
    found = rows.join(least, ["v", "place"]).withColumn("keep", keep).where("keep < first").groupBy("a", "b").agg(F.min("keep").alias("keep"))
    # verify each found pair
    ours, theirs = found.join(some.select("a", "b", "line"), ["a", "b"]), some.select(F.col("first").alias("keep"), F.col("line").alias("kept_line"))
    sure = ours.join(theirs, "keep").where("levenshtein(line, kept_line, 1) = 1")
    return C.written(sure.selectExpr("a", "b", "keep.k as keep_k", "keep.pos as keep_pos"), "near_lines")


def kept_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """k, t, bits: for each row with any, the places of lines that stay, 64 to a number."""
    lines = line_rows(docs, id_col, text_col)
    near = near_lines(lines, **options)
    first = lines.groupBy("a", "b").agg(F.min(F.struct("k", "pos", "t")).alias("first")).join(near, ["a", "b"], "left_anti")
    words = first.select("first.*").groupBy("k", "t", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    return words.groupBy("k", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def _applied(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """docs with __k, __t and __kept (struct: n lines, the lines that stay, or null for a null text)."""
    kept = kept_places(docs, id_col, text_col, **options).toDF("__k", "__t", "__bits")
    rows = docs.withColumns({"__k": C.doc_key(id_col), "__t": F.xxhash64(F.col(text_col))}).join(kept, ["__k", "__t"], "left")
    lines = f"split(`{text_col}`, '\\n')"
    dense = f"transform(sequence(0, (size({lines}) - 1) div 64), w -> coalesce(__bits[w], 0L))"
    stays = "trim(BOTH ' \\t\\r\\u000B\\f' FROM x) = '' or shiftright(d[i div 64], i % 64) & 1 = 1"
    picked = f"transform(array({dense}), d -> transform(array({lines}), l -> struct(size(l) as n, filter(l, (x, i) -> {stays}) as stay))[0])[0]"
    return rows.withColumn("__kept", F.expr(f"if(`{text_col}` is null, null, {picked})"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the lines that stay, joined by \\n), one row per input row."""
    found = _applied(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text", **options)
    return found.select(
        "doc_id", F.coalesce("__kept.n", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.expr("__kept.n - size(__kept.stay)"), F.lit(0)).cast("long").alias("n_removed"), F.array_join("__kept.stay", "\n").alias("kept"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the kept lines as text; all other columns as they were."""
    found = _applied(docs, id_col, text_col, **options)
    return found.withColumn(text_col, F.array_join("__kept.stay", "\n")).select(*docs.columns)


def op4_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(C.load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: One edit is told by deletions of one place, in characters: levenshtein of DuckDB counts bytes.
OP4_SQL = """
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as raw from documents where text is not null),
x as (select doc_id, pos, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as line from l),
f as (select line, min(struct_pack(d := doc_id, p := pos)) as first, length(line) as n from x where line <> '' group by line),
c as (select line, first, n, n as m, left(line, n // 2) as head, right(line, n // 2) as tail, (n // 2) as h from f),
s as (select line, first, n, unnest([n // 2, (n + 1) // 2, (n - 1) // 2]) as h from c),
keys as (select distinct line, first, n, h, unnest(['h' || left(line, h), 't' || right(line, h)]) as key from s),
gone as (select distinct y.line from keys y join keys z on y.key = z.key and y.h = z.h and abs(y.n - z.n) <= 1 and z.first < y.first and y.line <> z.line
  where len(list_filter(range(0, greatest(y.n, z.n)), lambda i: left(y.line, i) || substr(y.line, case when y.n >= z.n then i + 2 else i + 1 end)
    = left(z.line, i) || substr(z.line, case when z.n >= y.n then i + 2 else i + 1 end))) > 0),
mark as (select x.doc_id, x.pos, x.raw, x.line <> '' and (struct_pack(d := x.doc_id, p := x.pos) <> f.first or gone.line is not null) as removed
  from x left join f on x.line = f.line left join gone on x.line = gone.line),
per as (select doc_id, count(*) as n_lines, count(*) filter (removed) as n_removed, coalesce(string_agg(raw, chr(10) order by pos) filter (not removed), '') as kept from mark group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join per on d.doc_id = per.doc_id
"""
