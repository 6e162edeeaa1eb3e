import re

import pytest
from pyspark.sql import functions as F

from levelstream.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/x", "http://a.example.org/en/12?q=1", "http://a.example.org/en/2", "http://example.orgx/es/", "http://org/", "http://org",
    "http://COM/fr/", "https://b.com/de/", "https://b.com/de", "http://b.com?x=/de/", "http://b.net/a/?utm_source=f&b=2&a=1#top", "https://www.b.net:443/a?a=1&b=2", "http://b.net/a?a=1", "http://B.NET/A",
    "http://b.net//", "http://b.net", "x://y://z/p", "http://xorg/es/", "http://é.net/ü?ref", "http://b.net/" + "k" * 100_000, "http://b.net/a?a=1&b=2&ref=z", "http://u@b.net:8080/a?&&",
]


def plain(url, listed, rules=U.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    tail = rest[len(host) :]
    path = re.match(r"[^?#]*", tail)[0]
    query = re.search(r"^[^?#]*\?([^#]*)", rest)
    short = re.sub(r"^www\.", "", re.sub(r":(80|443)?$", "", host))
    args = sorted((a for a in (query[1] if query else "").split("&") if a and not re.match(r"utm_[^=]*(=|$)|(gclid|fbclid|msclkid|ref)(=|$)", a)), key=lambda a: a.encode())
    name = short + path.rstrip("/") + "/" + ("?" + "&".join(args) if args else "") if short else None
    fit = max((r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
    found = name is not None and name in listed
    return host, path, fit and fit[1] + fit[2], fit[0] if fit else "block" if found else "allow", name, None if fit else found


@pytest.mark.parametrize("blocks", [1, 64])
def test_against_plain(spark, blocks):
    listed = [None, "", "http://b.net/a/?b=2&a=1", "http://b.net/a/?a=1&b=2", "https://y:///z/p", "http://u@b.net:8080/a", "http://b.com?x=/de/", "http://org", *[f"http://l{i}.net/" for i in range(300)]]
    known = {plain(u, ())[4] for u in listed} - {None}
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[:3] + [f"http://l{i}.net" for i in range(0, 900, 7)])] + [(None, "http://b.net/a?a=1&b=2", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = U.filter_urls(pages, spark.createDataFrame([(u, 1) for u in listed], "url string, w0 int"), most_blocks=blocks)
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(i, *plain(u, known)) for i, u, _ in rows], key=key)


def test_filter_passes_all_that_is_listed_and_little_else(spark):
    listed = spark.range(4000).select(F.concat(F.lit("l"), "id").alias("canonical"))
    blocks = 128
    table = {r.block: r for r in U.bloom(listed, blocks).collect()}
    probes = spark.range(4000).select(F.concat(F.lit("l"), "id").alias("c"), F.lit(True).alias("own")).union(spark.range(20_000).select(F.concat(F.lit("o"), "id"), F.lit(False)))
    rows = probes.select("own", U._block(F.col("c"), blocks).alias("b"), F.array(*U._bits(F.col("c"))).alias("bits")).collect()
    passed = [r.own for r in rows if all(table[r.b][f"w{k}"] & bit for k, bit in enumerate(r.bits))]
    assert sum(passed) == 4000 and len(passed) - 4000 < 20_000 / 500


def test_equal_rules_and_bounds(spark):
    rules = (("allow", "a.net", "/b"), ("block", "a.net", "/b"), ("allow", "net", "/b/cd"))
    rows = spark.createDataFrame([(1, "http://a.net/b/cd"), (2, "http://a.net/b/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in U.filter_urls(rows, none, rules).collect()) == [(1, "net/b/cd", "allow"), (2, "a.net/b", "block")]
    assert U.filter_urls(rows.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        U.filter_urls(rows, none, rules * 400)
