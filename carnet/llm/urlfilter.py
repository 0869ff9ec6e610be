"""URL filters: a blocked Bloom filter of listed canonical URLs, and an exact hash join that removes its false positives.

Every listed URL sets ``BITS`` bits inside one 64-bit block. The filter grows with the list to ``MAX_BLOCKS`` blocks (some 8 million URLs at full strength) and is
broadcast up to that size; a longer list lets more URLs pass to the exact join. URLs that the filter refuses are surely not
listed and never shuffle; possible hits are joined with the list itself.

Rules (host, path, verdict) are a short parameter list and stand in the plan as one expression. A rule fits its host and all subdomains if
the URL's path starts with the rule's; the longest fitting rule decides, and the list only decides where no rule fits.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, no rule fits it, it is never listed and is allowed; repeated
pages are judged row by row; an empty list blocks nothing; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet.llm.common import fresh, lower_ascii
from carnet.session import cut_lineage

Rule = tuple[str, str, str]

BITS = 4
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 21
#: Query parameters that only track a visit; they are no part of a canonical URL.
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and the sorted parameters that do not track; without scheme and fragment. Null if no ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    full = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, full)


def rule_for(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct of rule text and verdict of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def mask_of(key: Column) -> Column:
    """The bits of a key inside its block, one per six bits of a second hash."""
    second = F.xxhash64(key, F.lit(1))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        place = F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63).cast("long"))
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")))
    return out


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Filter rows (block, word) of the listed keys; at most ``blocks`` rows."""
    return listed.select(block_of(F.col(key), blocks).alias("block"), mask_of(F.col(key)).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def filter_size(n: int) -> int:
    """Number of blocks for ``n`` keys, a power of two up to ``MAX_BLOCKS``."""
    return min(MAX_BLOCKS, 1 << max(4, (n * BITS_PER_KEY // 64).bit_length()))


def listed_in(rows: DataFrame, key: str, listed: DataFrame, listed_key: str, out: str) -> DataFrame:
    """The rows with boolean column ``out``: whether ``key`` is a listed one. Null keys are not."""
    block, word, hit = fresh(rows, "block"), fresh(rows, "word"), fresh(rows, "hit")
    keys = cut_lineage(listed.select(F.col(listed_key).alias(hit)).where(F.col(hit).isNotNull()).distinct())
    blocks = filter_size(keys.count())
    table = bloom(keys, hit, blocks).select(F.col("block").alias(block), F.col("word").alias(word))
    mask = mask_of(F.col(key))
    probed = rows.join(F.broadcast(table), (block_of(F.col(key), blocks) == F.col(block)) & (F.col(word).bitwiseAND(mask) == mask), "left")
    maybe = F.col(block).isNotNull()
    exact = probed.where(maybe).join(keys, F.col(key) == F.col(hit), "left").withColumn(out, F.col(hit).isNotNull()).drop(hit)
    return exact.unionByName(probed.where(~maybe).withColumn(out, F.lit(False))).drop(block, word)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """page_id, host, path, canonical URL, rule (null where none fits), and verdict: the rule's, else ``block`` for listed URLs and ``allow``
    for all others."""
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("canonical"))
    rows = rows.withColumn("fit", rule_for(rules, F.col("host"), F.col("path")))
    rows = rows.withColumn("asked", F.when(F.col("fit").isNull(), F.col("canonical")))
    rows = listed_in(rows, "asked", listed.select(canonical(F.col(listed_url)).alias("listed")), "listed", "listed")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "canonical", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))
