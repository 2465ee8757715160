"""URL filtering with DataFrame functions only.

Host and path rules decide first, the longest fitting rule winning. The rest is
checked against a list of canonical URLs: a blocked Bloom filter of the list
passes possible hits to an exact hash join, which removes false positives.

Defined cases: a null URL, or one without `://`, has empty host and path, fits
no rule, is on no list and is allowed; so is any URL when list and rules are
empty. Repeated rows are judged each for itself. Null entries of the list are
ignored. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit blocks of the filter, for each of which about this many keys are expected.
KEYS_PER_BLOCK = 5
#: Bits that a key sets in its block.
BITS = 4
#: The filter is broadcast up to this many blocks (16 bytes each, 8 MB); a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 19


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www., path without a final / or .html; scheme, query and fragment are left out."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The name or verdict of the longest rule that fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, field))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    second = F.xxhash64(key, F.lit(1))
    out = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocked filter as a table (block, bits)."""
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def on_list(pages: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """pages with a boolean column `listed`: whether its key is in the list."""
    listed = listed.where(F.col(key).isNotNull()).select(key).distinct()
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    table = bloom(listed, key, blocks)
    if blocks <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    p = pages.withColumns({"_block": _block(F.col(key), blocks), "_mask": _mask(F.col(key))})
    p = p.join(table.withColumnRenamed("block", "_block"), "_block", "left")
    p = p.withColumn("_maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
    sure = p.where("not _maybe").select(*pages.columns, F.lit(False).alias("listed"))
    maybe = p.where("_maybe").select(*pages.columns)
    exact = maybe.join(listed.select(key, F.lit(True).alias("listed")), key, "left")
    return sure.unionByName(exact.withColumn("listed", F.coalesce("listed", F.lit(False))))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", row_id: str = "page_id") -> DataFrame:
    """row_id, host, path, canonical, rule, listed, verdict of each page; listed has a column `canonical`."""
    p = pages.select(F.col(row_id), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    p = p.withColumns({
        "canonical": F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))),
        "rule": rule_for(F.col("host"), F.col("path"), rules, "name"),
        "_ruled": rule_for(F.col("host"), F.col("path"), rules, "verdict"),
    })
    ruled = p.where(F.col("_ruled").isNotNull()).withColumn("listed", F.lit(None).cast("boolean"))
    rest = on_list(p.where(F.col("_ruled").isNull()), listed)
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    out = ruled.unionByName(rest)
    return out.select(row_id, "host", "path", "canonical", "rule", "listed", F.coalesce("_ruled", method).alias("verdict"))


def listed_pages(pages: DataFrame, url: str = "url", row_id: str = "page_id") -> DataFrame:
    """A stand-in list for the query: canonical URLs of the pages whose id is divisible by 20."""
    p = pages.where(F.pmod(F.col(row_id), F.lit(20)) == 0).select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return p.where("host <> ''").select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()
