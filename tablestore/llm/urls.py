"""URL rules behind a blocked Bloom filter, in DataFrame functions only.

The listed canonical URLs (host followed by path) fill a blocked Bloom filter: a hash names one block of 64
bits, and three bits of the block are set. A url's candidates are its host's suffixes at dots, each followed by
the path's beginnings of the lengths that occur in the list. Candidates that the filter lets through meet the
list in an exact join, which removes the filter's false positives; the longest rule left decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablestore.llm.common import fresh

#: Filter bits for each listed URL, and bits set in a block.
BITS_PER_URL = 16
PROBES = 3
#: A filter or list of up to this many bytes is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 8 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _mask(key: Column) -> Column:
    """The bits of a URL in its block."""
    second = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES)]
    one = [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]
    out = one[0]
    for x in one[1:]:
        out = out.bitwiseOR(x)
    return out


def bloom_blocks(rules: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as rows (block, bits); blocks without bits are absent."""
    return rules.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each page: id, host, path, rule, verdict.

    `rules` has host, path and verdict; a rule fits its host and all subdomains if the url's path starts with
    its path. The longest rule (host and path together, then the longer host) wins; equal rules with both
    verdicts block. Without a rule, `rule` is null and the verdict is `default`. Null and odd urls have an
    empty host and path, which no rule fits; repeated rows each get their row; rules with null in host, path
    or verdict take no part. Verdicts are found once for each distinct (host, path).
    """
    h, p = host_path(F.col(url))
    rows = pages.select(F.col(id).alias("id"), h.alias("host"), p.alias("path"))
    listed = rules.where("host is not null and path is not null and verdict is not null").groupBy(
        F.concat("host", "path").alias("key"), F.length("host").alias("host_chars")).agg(F.max("verdict").alias("verdict"))
    # "block" sorts after "allow"
    n, size, lengths = listed.agg(F.count(F.lit(1)), F.sum(F.length("key") + 32), F.collect_set(F.length("key") - F.col("host_chars"))).first()
    blocks = max(1, n * BITS_PER_URL // 64)
    filter_rows = bloom_blocks(listed, "key", blocks)
    if blocks * 24 <= BROADCAST_BYTES:
        filter_rows = F.broadcast(filter_rows)
    if (size or 0) <= BROADCAST_BYTES:
        listed = F.broadcast(listed)

    # distinct urls; the empty host has no suffix
    urls = rows.select("host", "path").where("host != ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.array(*(F.lit(x) for x in sorted(lengths))) if lengths else F.array().cast("array<int>"), lambda k: F.when(F.length("path") >= k, F.substr(F.col("path"), F.lit(1), k)))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda x: F.struct(F.concat(s, x).alias("key"), F.length(s).alias("host_chars")))))
    asked = urls.select("host", "path", F.explode(pairs).alias("c")).select("host", "path", "c.*").where("key is not null")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    possible = asked.join(filter_rows, "block").where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    hits = possible.join(listed, ["key", "host_chars"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "host_chars", "key", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.key").alias("rule"), F.col("best.verdict").alias("found"))
    return rows.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
