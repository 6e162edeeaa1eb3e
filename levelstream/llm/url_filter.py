"""URL filter: rules by host and path, then a blocked Bloom filter of listed canonical addresses before an exact join.

DataFrame functions only. The filter has blocks of 512 bits, eight words of 64; an address has one block and one bit
in each word. It is built by one aggregation that combines before it shuffles, and never has more than MOST_BLOCKS
blocks, so it is sent to all tasks whatever the length of the list: a longer list fills it more, and more rows that
are not listed go on to the join. Only rows that no rule fits and that pass the filter are joined to the list, which
takes out false positives; all others cross no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host and path of the query's rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules are literals of the plan; more are refused.
MOST_RULES = 1000
WORDS, WORD_BITS = 8, 64
#: Addresses of a block, at which a false positive is one in about 1,600, and the most blocks (about 12 MB in a task).
BLOCK_KEYS, MOST_BLOCKS = 32, 1 << 17
SEED = 13
#: Query parameters that name no content, and default ports.
TRACKING = r"^(utm_[^=]*|gclid|fbclid|msclkid|ref)(=|$)"
PORT = r":(80|443)?$"
#: What the query lists: pages with so many runs of three equal signs.
JUNK, JUNK_RUNS = r"[*]{3}|[#]{3}|[$]{3}|[%]{3}", 20


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of an address; null or no ``://``: all empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def canonical(host: Column, path: Column, query: Column) -> Column:
    """One spelling of an address: no scheme, ``www.``, default port, fragment, tracking or order of parameters, and no slash at the end; null without a host."""
    short = F.regexp_replace(F.regexp_replace(host, PORT, ""), r"^www\.", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    more = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(short != "", F.concat(short, F.regexp_replace(path, r"/+$", ""), F.lit("/"), more))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equals the one with the longer host, then a block; null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """A word with one bit for each word of a block."""
    bits = F.xxhash64(F.lit(SEED + 1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 6 * k).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) for k in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks of the filter that hold a bit, of rows (canonical)."""
    key = F.col("canonical")
    words = [F.bit_or(bit).alias(f"w{k}") for k, bit in enumerate(_bits(key))]
    return listed.groupBy(_block(key, blocks).alias("block")).agg(*words)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, canonical, listed.

    ``listed`` has a column url. A rule decides where one fits; otherwise an address is blocked if its canonical form
    is one of the list's, and ``listed`` says so (null where a rule decided). A null url or one without ``://`` has
    an empty host and path, no canonical form, and is allowed; such rows of the list name nothing. Repeated rows stay
    and rows of the list count once; very long addresses are like any other; an empty table gives an empty one; other
    columns are ignored.
    """
    named = listed.select(canonical(*parts(F.col("url"))).alias("canonical")).where("canonical is not null").distinct()
    named = materialize(named, "listed-urls")
    blocks = 1
    while blocks * BLOCK_KEYS < named.count() and blocks < most_blocks:
        blocks *= 2
    host, path, query = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), query.alias("query"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), canonical(F.col("host"), F.col("path"), F.col("query")).alias("canonical"))
    probed = rows.withColumn("block", _block(F.col("canonical"), blocks)).join(F.broadcast(bloom(named, blocks)), "block", "left")
    has = F.lit(True)
    for k, bit in enumerate(_bits(F.col("canonical"))):
        has = has & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    possible = F.coalesce(F.col("rule").isNull() & F.col("canonical").isNotNull() & has, F.lit(False))
    probed = probed.select("page_id", "host", "path", "rule", "ruled", "canonical", possible.alias("possible"))
    sure = probed.where(~F.col("possible")).withColumn("found", F.lit(False))
    hits = probed.where("possible").join(named.withColumn("found", F.lit(True)), "canonical", "left").select(*sure.columns)
    found = F.coalesce("found", F.lit(False))
    verdict = F.coalesce("ruled", F.when(found, "block").otherwise("allow"))
    return sure.unionByName(hits).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "canonical", F.when(F.col("rule").isNull(), found).alias("listed"))


def query(spark, sf_dir: str) -> DataFrame:
    """The list is that of the addresses of pages that are junk; other fetches of such a page go with it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(F.regexp_count("html", F.lit(JUNK)) >= JUNK_RUNS).select("url")
    return filter_urls(pages.select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def _oracle() -> str:
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = lambda r: f"(host = '{r[1]}' or ends_with(host, '.{r[1]}')) and starts_with(path, '{r[2]}')"
    cases = lambda value: "case " + " ".join(f"when {fits(r)} then '{value(r)}'" for r in ordered) + " end"
    return f"""
with split as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
named as (
  select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) as query from split),
kept as (
  select *, regexp_replace(regexp_replace(host, '{PORT}', ''), '^www\\.', '') as short,
    list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' and not regexp_matches(p, '{TRACKING}'))) as args from named),
spelt as (
  select page_id, html, host, path, {cases(lambda r: r[1] + r[2])} as rule, {cases(lambda r: r[0])} as ruled,
    case when short <> '' then short || regexp_replace(path, '/+$', '') || '/' || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end end as canonical from kept),
listed as (select distinct canonical from spelt where canonical is not null and len(regexp_extract_all(html, '{JUNK}')) >= {JUNK_RUNS})
select page_id, host, path, rule, coalesce(ruled, case when l.canonical is not null then 'block' else 'allow' end) as verdict, s.canonical,
  case when rule is null then l.canonical is not null end as listed
from spelt s left join listed l on s.canonical = l.canonical
"""


ORACLE = _oracle()
