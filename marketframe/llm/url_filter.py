"""URL verdicts by host and path rules, else by a list of canonical URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.storage import materialise

from .batches import table

#: Rule text (host and path) and verdict.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

#: The query lists the URLs of pages on these hosts.
LISTED_HOSTS = "(^|[.])(spam-farm|cheap-pills)[.]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A block is one 64-bit word for 8 URLs, each of which sets up to 4 of its bits.
URLS_PER_BLOCK, BITS_PER_URL = 8, 4


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one and for null."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)


def canonical_of(url: Column) -> Column:
    """Host, path without closing slashes, and the query without utm parameters; the
    scheme, default ports and the fragment go. Null without a ``://``."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(rest_of(url), "^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts like its own."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, start = rule.partition("/")
        same = (host == name) | F.endswith(host, F.lit(f".{name}"))
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(same & F.startswith(path, F.lit(f"/{start}")), hit))
    return F.coalesce(*fits)


def _bits(url: Column) -> Column:
    """The bits that a URL sets in its block."""
    h = F.xxhash64(url, F.lit(1))
    spots = [F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(BITS_PER_URL)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("bigint"), s) for s in spots])


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``_block, _word``: the blocks of a Bloom filter of column ``canonical``. It is a
    table, so it may be larger than any one executor."""
    rows = listed.select(_block(F.col("canonical"), blocks).alias("_block"), _bits(F.col("canonical")).alias("_bits"))
    return rows.groupBy("_block").agg(F.bit_or("_bits").alias("_word"))


def listed_among(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The different values of ``canonical`` in ``urls`` that ``listed`` holds.

    ``listed`` has each URL once. The filter has a block for every 8 listed URLs
    (their number is the one figure that reaches the driver); what it lets pass goes
    to an exact join. Null is never listed.
    """
    blocks = max(1, -(-listed.count() // URLS_PER_BLOCK))
    different = urls.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    keyed = different.withColumns({"_block": _block(F.col("canonical"), blocks), "_bits": _bits(F.col("canonical"))})
    possible = keyed.join(bloom_filter(listed, blocks), "_block").where(F.expr("(_word & _bits) = _bits"))
    return possible.select("canonical").join(listed, "canonical", "left_semi")


def judge(
    pages: DataFrame, listed: DataFrame, rules=RULES, key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key, host, path, canonical, rule, listed, verdict`` of every row of ``pages``.

    ``listed`` has URLs in column ``url``, in any form, repeated or null; it may be
    empty. A rule's verdict stands before the list; without either it is ``allow``.
    A null URL and one without ``://`` has an empty host and path, no rule and is not
    listed. Repeated rows and null keys get a row each; other columns are not read.
    """
    link = F.col(url)
    rows = pages.select(F.col(key), host_of(link).alias("host"), path_of(link).alias("path"), canonical_of(link).alias("canonical"))
    names = materialise(
        listed.select(canonical_of(F.col("url")).alias("canonical")).where(F.col("canonical").isNotNull()).distinct()
    )
    hits = listed_among(rows, names).withColumn("_hit", F.lit(True))
    # URLs that have no canonical form would all meet in the task of null.
    by = F.coalesce("canonical", F.concat(F.lit("\n"), F.xxhash64(key).cast("string")))
    found = rows.withColumn("_by", by).join(hits.withColumnRenamed("canonical", "_by"), "_by", "left")
    found = found.withColumns({"_rule": rule_of(F.col("host"), F.col("path"), rules), "listed": F.coalesce("_hit", F.lit(False))})
    return found.select(
        key, "host", "path", "canonical", F.col("_rule.rule").alias("rule"), "listed",
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, pages.where(host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url"))


_LOWERED = f"translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
_ORDERED = sorted(RULES, key=lambda r: -len(r[0]))


def _case(value: int) -> str:
    arms = []
    for rule in _ORDERED:
        name, _, start = rule[0].partition("/")
        arms.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{start}') THEN '{rule[value]}'")
    return f"CASE {' '.join(arms)} END"


SQL = f"""WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url, {_LOWERED} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM cut),
named AS (
  SELECT *, CASE WHEN instr(url, '://') > 0 THEN
    regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    END AS canonical
  FROM parts),
list AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED_HOSTS}') AND canonical IS NOT NULL),
ruled AS (SELECT *, {_case(0)} AS rule, {_case(1)} AS judged, canonical IS NOT NULL AND canonical IN (FROM list) AS listed FROM named)
SELECT page_id, host, path, canonical, rule, listed,
       coalesce(judged, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
