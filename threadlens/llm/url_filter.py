"""URL filter: rules first, then a list of canonical URLs.

The list is held as a blocked Bloom filter: each listed URL sets 8 bits in one
256-bit block (four longs, two bits in each). The number of blocks follows the
list up to ``max_blocks``, so the broadcast filter never exceeds
``max_blocks`` x 40 bytes whatever the list's size; beyond that only the share
of false positives rises. URLs that the filter rules out never move. Possible
hits go through an exact hash join with the list, which removes the false
positives. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.staging import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URLS_PER_BLOCK = 16
MAX_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#``; A-Z lowered; else empty."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.`` and path without trailing slashes; scheme, query and
    fragment are dropped. Null where there is no host."""
    return F.when(
        host != "",
        F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")),
    )


def rule_column(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """``field`` of the longest rule that fits, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; put longer lists into `listed`")
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, getattr(r, field)) if out is None else out.when(fits, getattr(r, field))
    return F.lit(None).cast("string") if out is None else out


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _word(url: Column, i: int) -> Column:
    """The two bits that a URL has in long ``i`` of its block."""
    h = F.xxhash64(url, F.lit(1))
    bit = lambda shift: F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
    )
    return bit(12 * i).bitwiseOR(bit(12 * i + 6))


def bloom_blocks(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """(block, w0..w3): the blocked Bloom filter as a table of at most ``blocks`` rows."""
    url = F.col(url_col)
    return (
        listed.filter(url.isNotNull())
        .groupBy(_block(url, blocks).alias("block"))
        .agg(*[F.bit_or(_word(url, i)).alias(f"w{i}") for i in range(4)])
    )


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "url",
    max_blocks: int = 1 << 20,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, listed.

    ``listed`` holds canonical URLs to block (nulls are ignored, repeats are
    harmless). The verdict is the longest fitting rule's; else block if the
    page's canonical URL is listed, else allow. A null URL or one without
    ``://`` has an empty host and path, fits no rule, is never listed and is
    allowed. Repeated pages are each judged; an empty table gives no rows.
    """
    listed = stage(
        listed.select(F.col(listed_col).alias("canonical")).filter("canonical is not null").distinct(),
        "listed-urls",
    )
    blocks = max(1, min(max_blocks, listed.count() // URLS_PER_BLOCK + 1))
    bloom = bloom_blocks(listed, "canonical", blocks)
    # Aliases keep Spark from folding the URL expressions into each use.
    parsed = pages.select(
        F.col(id_col).alias("page_id"),
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
    )
    host, path = F.col("host"), F.col("path")
    judged = parsed.select(
        "page_id",
        "host",
        "path",
        rule_column(host, path, rules, "text").alias("rule"),
        rule_column(host, path, rules, "verdict").alias("ruled"),
        canonical_url(host, path).alias("canonical"),
    ).withColumn("block", _block(F.col("canonical"), blocks))
    words = [F.col(f"w{i}").bitwiseAND(_word(F.col("canonical"), i)) == _word(F.col("canonical"), i) for i in range(4)]
    possible = words[0] & words[1] & words[2] & words[3]
    probed = judged.join(F.broadcast(bloom), "block", "left").select(
        "page_id", "host", "path", "rule", "ruled", "canonical",
        F.coalesce(F.col("canonical").isNotNull() & possible, F.lit(False)).alias("possible"),
    )
    hits = probed.filter("possible").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    rest = probed.filter("not possible").withColumn("listed", F.lit(False))
    columns = ["page_id", "host", "path", "rule", "ruled", "listed"]
    return (
        hits.select(*columns)
        .unionByName(rest.select(*columns))
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
            F.coalesce("listed", F.lit(False)).alias("listed"),
        )
    )
