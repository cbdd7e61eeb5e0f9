import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filters as U
from tidemark.llm.queries import URL_RULES


@pytest.mark.parametrize("n", [0, 1, 30, 20_000])
def test_cascade_is_exact_over_its_universe(n):
    rng = np.random.default_rng(n)
    first, second = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
    for share in (0, 0.001, 0.3, 0.9, 1):
        listed = rng.random(n) < share
        levels = U.build_cascade(first, second, listed)
        assert (U.in_cascade(levels, first, second) == listed).all()
        if n > 1000 and share == 0.3:
            assert sum(x[0] for x in levels) < 8 * listed.sum() + 1000


@pytest.mark.parametrize("most", [U.MAX_BROADCAST_BYTES, -1])
def test_membership_by_broadcast_and_by_shards(spark, monkeypatch, most):
    monkeypatch.setattr(U, "SHARD_KEYS", 300)
    monkeypatch.setattr(U, "GROUP_ROWS", 50)
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
                                    F.lit("mine").alias("listed"))
    listed = spark.createDataFrame([("hot",), ("k7",), ("k7",), ("k1000",), ("absent",), (None,)], "key string")
    shards, n = U.cascade(rows.select("key"), listed, 300)
    out = U.with_membership(rows, F.col("key"), shards, n, most)
    assert out.count() == 3000
    assert {r[0] for r in out.filter("listed").select("key").distinct().collect()} == {"hot", "k7", "k1000"}


def judged(url, listed):
    head, mark, rest = (url or "").partition("://")
    host = path = ""
    if mark:
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].partition("#")[0].partition("?")[0]
    fits = [(a, h + p) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda x: len(x[1]), default=(None, None))
    return host, path, best[1], best[0] or ("block" if host + path in listed else "allow")


def test_odd_urls(spark):
    urls = [None, "", "nothing", "://", "http://", "http://A.ORG", "http://a.org/", "HTTP://www.Example.ORG/es/x", "x://example.org/en/12?a#b",
            "http://notexample.org/es/", "https://com/fr/", "https://shop.com/de/a?x://y/z", "https://shop.com/de", "ftp://user@h.net:80/p#q?r",
            "http://é.net/ü", "http://a.net?q=/x", "http://a.net#f", "a\nb://h.net/x\ny?z", "http://h.net/dup", "http://h.net/dup?other"]
    rows = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, rule string")
    names = {"h.net/dup", "", "com/fr/", "never.net/x"}
    listed = spark.createDataFrame([(x,) for x in names], "key string")
    for most in (U.MAX_BROADCAST_BYTES, -1):
        out = U.judge_urls(rows, URL_RULES, listed, max_broadcast_bytes=most).select("page_id", "host", "path", "rule", "verdict").collect()
        assert len(out) == 2 * len(urls)
        for r in out:
            assert tuple(r)[1:] == judged(urls[r["page_id"] % len(urls)], names), urls[r["page_id"] % len(urls)]
    assert U.judge_urls(rows.limit(0), URL_RULES, listed).count() == 0
    assert U.judge_urls(rows, [], listed.limit(0)).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
