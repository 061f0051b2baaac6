"""URL filter: rules by host and path, else gradient-boosted trees on lexical features, in DataFrame operations only.

Rules decide what they fit. The URLs that rules decide are the labelled ones; from them boosted trees learn to judge the rest.
Features are whole numbers (bins), so labelled URLs collapse to distinct cells with a count of each label: one aggregation over
all rows, after which every level of every tree is one small aggregation of gradients by node, feature and bin. Of these sums the
driver sees at most nodes x features x bins. The fitted trees become one SQL expression, so scoring is a plain projection.

Features: length of the URL, depth of the path, share of digits, entropy of the characters, number of parameters, labels of
the host, length of the host, length of the longest path segment, and for the suffix (last label of the host) the share of its
labelled URLs that are blocked and its frequency. That share is out of fold - a labelled URL's own hosts' fold is left out, few
labels are drawn to the overall share - and a suffix whose labelled URLs all have one label, which says no more than the rule
that gave them, is neutral in both.

Defined results: a null URL or one without `://` has empty host and path, fits no rule and is judged by the trees (a null as an
empty string); without labelled URLs of both kinds nothing is learned and `allow` is given; repeated rows get equal results;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm import common as C

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BINS = 32
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def split_url(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with host and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = rows.withColumn("__rest", F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit("")))
    rows = rows.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(__rest, length(__host) + 1)"), "^[^?#]*", 0)
    return rows.select(*[c for c in rows.columns if c not in ("__rest", "__host")], F.translate("__host", UPPER, UPPER.lower()).alias("host"), path.alias("path"))


def rule_of(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = text.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits &= F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


#: Name and SQL of each feature's number before it is cut to a bin; u: the URL, q: what follows the path.
FEATURES = {
    "length": "length(u) div 4",
    "depth": "size(filter(split(path, '/'), x -> x <> ''))",
    "digits": "cast(64 * length(regexp_replace(u, '[^0-9]', '')) / greatest(length(u), 1) as int)",
    "entropy": "cast(5 * aggregate(array_distinct(split(u, '')), 0D, (e, c) -> if(c = '', e, e - (length(u) - length(replace(u, c, ''))) / length(u) * log2((length(u) - length(replace(u, c, ''))) / length(u)))) as int)",
    "parameters": "if(instr(u, '?') > 0, size(split(substring_index(substring(u, instr(u, '?')), '#', 1), '&')), 0)",
    "host_labels": "size(split(host, '[.]'))",
    "host_length": "length(host) div 2",
    "longest_segment": "array_max(transform(split(path, '/'), x -> length(x))) div 2",
    "suffix_blocked": "cast(31 * if(mixed, (blocked_all - own * blocked + {prior} * {share}) / (labelled_all - own * labelled + {prior}), {share}) as int)",
    "suffix_frequency": "if(mixed, cast(log2(1 + urls_all) as int), 0)",
}


def featured(rows: DataFrame, url_col: str, *, folds: int = 5, prior: int = 20) -> DataFrame:
    """rows (with host, path and label: 1 block, 0 allow, else null) with a bin for each feature as f_<name>. Folds are of hosts."""
    rows = rows.withColumns({"suffix": F.substring_index("host", ".", -1), "u": F.coalesce(F.col(url_col).cast("string"), F.lit("")), "fold": F.pmod(F.xxhash64("host"), F.lit(folds)).cast("int")})
    per = rows.groupBy("suffix", "fold").agg(F.count("*").alias("urls"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    per = C.written(per, "suffixes")
    whole = per.groupBy("suffix").agg(*[F.sum(x).alias(f"{x}_all") for x in ("urls", "labelled", "blocked")])
    told = per.agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    share = told.b / told.n if told.n else 0.5
    bins = [F.expr(f"cast(least(greatest({sql.format(prior=prior, share=repr(share) + 'D')}, 0), {BINS - 1}) as int)").alias(f"f_{name}") for name, sql in FEATURES.items()]
    # Spark broadcasts the suffixes if the written table is small enough
    joined = rows.join(whole, "suffix", "left").join(per.select("suffix", "fold", "labelled", "blocked"), ["suffix", "fold"], "left")
    joined = joined.withColumns({"own": F.expr("int(label is not null)"), "mixed": F.expr("blocked_all > 0 and blocked_all < labelled_all")})
    return joined.select(*[c for c in rows.columns if c not in ("suffix", "u", "fold")], *bins)


@dataclass(frozen=True)
class Node:
    """A split (feature bin <= cut goes left) or a leaf with its value."""

    value: float = 0.0
    feature: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def sql(self) -> str:
        if self.feature is None:
            return f"{self.value!r}D"
        return f"if(f_{self.feature} <= {self.cut}, {self.left.sql()}, {self.right.sql()})"


def _leaf(g: float, h: float, rate: float, ridge: float) -> Node:
    return Node(rate * g / (h + ridge))


def fit(labelled: DataFrame, *, trees: int = 10, depth: int = 3, rate: float = 0.5, ridge: float = 1.0, most_cells: int = 50_000, features: Iterable[str] = FEATURES) -> list[Node]:
    """Boosted trees for the log-odds of block. labelled: label and the feature bins. The fit uses the most_cells most frequent
    cells of equal features - a documented bound on its work, by which no row of the corpus goes unjudged."""
    told = list(features)
    names = [f"f_{x}" for x in told]
    cells = labelled.where("label is not null").groupBy(*names).agg(F.sum("label").cast("double").alias("blocks"), F.count("*").cast("double").alias("n"))
    cells = C.written(cells.orderBy(F.desc("n"), *names).limit(most_cells), "url_cells")
    total = cells.agg(F.sum("blocks").alias("b"), F.sum("n").alias("n")).first()
    if not total.n or not 0 < total.b < total.n:
        return []
    fitted = [Node(math.log(total.b / (total.n - total.b)))]
    for _ in range(trees):
        p = f"1 / (1 + exp(-({' + '.join(x.sql() for x in fitted)})))"
        graded = cells.selectExpr(*names, "n", "blocks", f"{p} as p").selectExpr(*names, "blocks - n * p as g", "n * p * (1 - p) as h")
        splits: dict[str, tuple[str, int]] = {}  # by path of the node: L and R
        sums: dict[str, tuple[float, float]] = {}
        for level in range(depth):
            node = _case(splits, "") or "''"
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(x).alias("bin")) for i, x in enumerate(names)])).alias("x")
            rows = graded.select(F.expr(node).alias("node"), "g", "h", each).groupBy("node", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            grown = _best_splits(rows, ridge, sums, level)
            for path, (f, cut) in grown.items():
                splits[path] = (told[f], cut)
            if not grown:
                break
        fitted.append(_tree("", splits, sums, rate, ridge))
    return fitted


def _case(splits: dict[str, tuple[str, int]], path: str) -> str | None:
    """SQL for the path of the node that a row reaches from the node at `path`; None if that is no split."""
    if path not in splits:
        return None
    feature, cut = splits[path]
    left, right = (_case(splits, path + side) or f"'{path}{side}'" for side in "LR")
    return f"if(f_{feature} <= {cut}, {left}, {right})"


def _best_splits(rows: list, ridge: float, sums: dict[str, tuple[float, float]], level: int) -> dict[str, tuple[int, int]]:
    """The split of largest gain for each node of this level, and the gradient sums of all nodes that appear."""
    by: dict[tuple[str, int], dict[int, tuple[float, float]]] = {}
    for r in rows:
        by.setdefault((r.node, r.f), {})[r.bin] = (r.g, r.h)
    best: dict[str, tuple[float, int, int]] = {}
    worth = lambda g, h: g * g / (h + ridge)
    for (path, f), bins in sorted(by.items()):
        g_all, h_all = (math.fsum(x[i] for x in bins.values()) for i in (0, 1))
        sums.setdefault(path, (g_all, h_all))
        if len(path) != level:
            continue
        g = h = 0.0
        for cut in sorted(bins)[:-1]:
            g, h = g + bins[cut][0], h + bins[cut][1]
            gain = worth(g, h) + worth(g_all - g, h_all - h) - worth(g_all, h_all)
            if gain > 1e-6 and gain > best.get(path, (0.0,))[0] * (1 + 1e-9):
                best[path] = (gain, f, cut)
                sums[path + "L"], sums[path + "R"] = (g, h), (g_all - g, h_all - h)
    return {path: (f, cut) for path, (_, f, cut) in best.items()}


def _tree(path: str, splits: dict[str, tuple[str, int]], sums: dict[str, tuple[float, float]], rate: float, ridge: float) -> Node:
    if path not in splits:
        return _leaf(*sums[path], rate, ridge)
    return Node(0.0, *splits[path], _tree(path + "L", splits, sums, rate, ridge), _tree(path + "R", splits, sums, rate, ridge))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", **training) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log-odds of block; null if nothing was learned), one row per input row."""
    rows = split_url(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    rule, verdict = rule_of(rules)
    rows = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    rows = featured(rows.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)), "url")
    fitted = fit(rows, **training)
    score = F.expr(" + ".join(x.sql() for x in fitted)) if fitted else F.lit(None).cast("double")
    scored = rows.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")


def held_out(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url", *, features: Iterable[str] = FEATURES, **training) -> tuple[float, int]:
    """Accuracy on, and number of, the labelled URLs of a fifth of the hosts, with trees that are fitted on those of the others;
    the suffix statistics don't see the labels of that fifth either."""
    rule, verdict = rule_of(rules)
    rows = split_url(pages.select(F.col(url_col).alias("url"))).withColumn("verdict", verdict)
    rows = rows.withColumns({"truth": F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0), "away": F.pmod(F.xxhash64("host", F.lit("held out")), F.lit(5)) == 0})
    bins = featured(rows.withColumn("label", F.when(~F.col("away"), F.col("truth"))), "url")
    trees = fit(bins, features=features, **training)
    score = F.expr(" + ".join(x.sql() for x in trees)) if trees else F.lit(0.0)
    told = bins.where("away and truth is not null").agg(F.avg(((score > 0).cast("int") == F.col("truth")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    return told.right or 0.0, told.n


def op2_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.load(spark, sf_dir, "pages"))
