"""Queue names, their paths and their settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.functions.ids import file_path

#: What a queue gets that no rule fits.
DEFAULT_COMPRESSION, DEFAULT_ENCRYPTION, DEFAULT_FSYNC = "ZSTD", "AES", True


def resolve(name: Column, instance: str) -> Column:
    """An absolute name stays; a relative one is put under the instance."""
    return F.when(name.startswith("/"), name).otherwise(F.concat(F.lit(f"/{instance}/"), name))


def segment_path(root: str, queue: Column, tier: str, file_id: Column) -> Column:
    """tier: wal or store."""
    return F.concat(F.lit(root.rstrip("/")), queue, F.lit(f"/{tier}/"), file_path(file_id, f".{tier}"))


def cloud_key(prefix: str, queue: Column, file_id: Column) -> Column:
    """Key of a stored segment, the same for upload and download."""
    return F.concat(F.lit(prefix), F.regexp_replace(queue, "^/", ""), F.lit("/"), file_path(file_id, ".store"))


def glob_to_regex(glob: str) -> str:
    """`*` any run of characters, `?` one character, `[..]` a class, `{a,b}` alternatives, `\\` before a plain character."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
            i += glob[i : i + 2] == "**"
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def settings(queues: DataFrame, rules: list[tuple[int, str, str, str, bool]]) -> DataFrame:
    """compression, encryption and fsync of each queue: of the rule of lowest priority number whose glob fits, else defaults.

    Rules are a configured list, so they become one CASE expression: no join."""
    picked = F.struct(F.lit(DEFAULT_COMPRESSION).alias("compression"), F.lit(DEFAULT_ENCRYPTION).alias("encryption"), F.lit(DEFAULT_FSYNC).alias("fsync"))
    for _, glob, compression, encryption, fsync in sorted(rules, reverse=True):
        fits = F.struct(F.lit(compression).alias("compression"), F.lit(encryption).alias("encryption"), F.lit(fsync).alias("fsync"))
        picked = F.when(F.col("queue").rlike(glob_to_regex(glob)), fits).otherwise(picked)
    return queues.withColumn("_set", picked).select(*queues.columns, "_set.*")


def settings_from_table(queues: DataFrame, rules: DataFrame) -> DataFrame:
    """As settings, for rules (priority, regex, compression, encryption, fsync) in a table."""
    joined = queues.join(rules, F.rlike("queue", "regex"), "left")
    rank = F.row_number().over(Window.partitionBy("queue").orderBy("priority"))
    chosen = joined.withColumn("_rank", rank).where("_rank = 1")
    defaults = {"compression": DEFAULT_COMPRESSION, "encryption": DEFAULT_ENCRYPTION, "fsync": DEFAULT_FSYNC}
    return chosen.select("queue", *[F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in defaults.items()])
