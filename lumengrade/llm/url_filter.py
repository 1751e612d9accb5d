"""URL filters, native: host and path rules first, then a blocked Bloom filter of listed URLs and an exact hash join.

The listed canonical URLs are hashed into blocks of one 64-bit word each; a URL sets `probes` bits of its block. The words of all
blocks are one array of at most `most` longs (8 MB), sized by the list, which a scalar subquery hands to the scan of the pages: no page is shuffled or
joined to consult it. Only pages whose bits are all set, possible hits, go on to the exact join with the list, which removes
false positives; they are more where a list is so long that the array's bound leaves it few bits, and the result is the same.

Defined results: null URLs and URLs without '://' have empty host and path, fit no rule, are never listed and are
allowed (they never reach the join); hosts fit a rule by whole labels; repeated rows are judged one by one; null or blank listed URLs are ignored and listed
URLs count once; an empty list blocks nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LISTED_HOST = "spam-farm.example.org"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without leading www. and default port, path without closing slash or .html, query without utm_ fields; no scheme, no fragment."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "([.]html)?/*$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&+|&+$", "")
    joined = F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(host == "", F.lit(None)).otherwise(joined)


def rule_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Rules are a short parameter list."""
    rule = verdict = None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _bits(key: Column, probes: int) -> Column:
    """The word of a URL's probes: bits taken from independent 6-bit fields of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("long")
    for k in range(probes):
        field = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), field))
    return word


def bloom(listed: DataFrame, blocks: int, probes: int = 5, page: int = 1024) -> DataFrame:
    """One row with the array `words` of the blocks' bits, made of listed(canonical) in pages of `page` words."""
    bits = listed.groupBy(F.pmod(F.xxhash64("canonical"), F.lit(blocks)).alias("block")).agg(F.bit_or(_bits(F.col("canonical"), probes)).alias("bits"))
    every = listed.sparkSession.range(blocks).withColumnRenamed("id", "block").join(bits, "block", "left").select("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    pages = every.groupBy(F.floor(F.col("block") / page).alias("page")).agg(ordered("block", "bits").alias("part"))
    return pages.agg(F.flatten(ordered("page", "part")).alias("words"))


def possible_hits(urls: DataFrame, listed: DataFrame, most: int = 1 << 20, probes: int = 5) -> DataFrame:
    """urls(canonical, ...) with boolean `maybe`: false only for URLs that are not in listed(canonical), a stored table of distinct URLs."""
    blocks = 1
    while blocks < min(most, listed.count() / 4):
        blocks *= 2
    word = F.get(stored(bloom(listed, blocks, probes), "bloom").scalar(), F.pmod(F.xxhash64("canonical"), F.lit(blocks)).cast("int"))
    need = _bits(F.col("canonical"), probes)
    return urls.withColumn("maybe", F.col("canonical").isNotNull() & F.coalesce(word.bitwiseAND(need) == need, F.lit(False)))


def listed_hits(urls: DataFrame, listed: DataFrame, most: int = 1 << 20, probes: int = 5) -> DataFrame:
    """urls(page_id, host, path, canonical) with boolean `listed`."""
    listed = stored(listed.where("canonical <> ''").select("canonical").distinct(), "listed")
    seen = possible_hits(urls, listed, most, probes)
    exact = listed.select(F.col("canonical").alias("known"), F.lit(True).alias("found"))
    maybe = seen.where("maybe").join(exact, F.col("canonical") == F.col("known"), "left").select(*urls.columns, F.col("found").isNotNull().alias("listed"))
    return maybe.unionByName(seen.where("not maybe").select(*urls.columns, F.lit(False).alias("listed")))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, most: int = 1 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of pages(page_id, url); listed(url) is the block list."""
    url = F.col("url")
    # Written once: both branches below read the parts, and no expression over them works the address out again.
    urls = stored(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical")), "urls")
    got = listed_hits(urls, listed.select(canonical(F.col("url")).alias("canonical")), most)
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return got.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def reported(pages: DataFrame) -> DataFrame:
    """(url) of the block list that pages themselves give: addresses that come with a tracking field, and those of the spam host. Other
    pages of the same canonical address (without the field, with www., .html or a closing slash) are then listed as well."""
    host = host_of(F.col("url"))
    tracked = F.col("url").rlike("[?&]utm_[^&#]*")
    return pages.where(tracked | (host == LISTED_HOST) | F.endswith(host, F.lit(f".{LISTED_HOST}"))).select("url")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No list table is given, so the list is what `reported` finds in pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, reported(pages))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, rest,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '') AS q FROM cut),
canon AS (
  SELECT page_id, url, host, path,
         regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') AS h,
         regexp_replace(path, '([.]html)?/*$', '') AS p,
         regexp_replace(regexp_replace(q, '(^|&)utm_[^&]*', '', 'g'), '^&+|&+$', '', 'g') AS q FROM parts),
keyed AS (
  SELECT page_id, url, host, path, CASE WHEN h = '' THEN NULL ELSE h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS c FROM canon),
spam AS (
  SELECT DISTINCT c FROM keyed WHERE c <> '' AND (regexp_matches(url, '[?&]utm_') OR host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org')),
ruled AS (
  SELECT k.page_id, k.host, k.path, s.c IS NOT NULL AS listed,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM keyed k LEFT JOIN spam s ON k.c = s.c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
