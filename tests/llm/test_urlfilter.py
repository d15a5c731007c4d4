import random

import pytest
from sitegauge.llm import urlfilter


def plain(url, rules):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), v == "block", h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], "allow" if best is None else ("block" if best[1] else "allow")


def urls(seed, n):
    draw = random.Random(seed)
    names, tops = ["a", "bb", "c-c", "shop", "www", "example"], ["org", "com", "net", "co.uk"]
    out = []
    for _ in range(n):
        host = ".".join(draw.choices(names, k=draw.randint(0, 3)) + [draw.choice(tops)])
        path = draw.choice(["", "/", "/es/", "/en/1", "/en/12?x=/es/", "/de#f", "/fr/a/b", "?q=/fr/", "#/"])
        out.append(f"{draw.choice(['http', 'https', 'HTTP'])}://{host.upper() if draw.random() < 0.2 else host}{path}")
    return out


def check(spark, addresses, rules):
    pages = spark.createDataFrame(list(enumerate(addresses)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    rows = urlfilter.judged(pages, table).collect()
    assert len(rows) == len(addresses)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(addresses[r.page_id], rules), addresses[r.page_id]


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("co.uk", "", "block"), ("www.a.net", "/", "block"), ("net", "/es/", "block"),
         ("net", "/es/", "allow")]


def test_rules(spark):
    check(spark, urls(1, 600), RULES)


@pytest.mark.parametrize("block_bytes", [4_000_000, 40])
def test_many_rules(spark, monkeypatch, block_bytes):
    """Filters so small that keys pass wrongly, so several levels are needed; and lists in several blocks."""
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(urlfilter, "BLOCK_BYTES", block_bytes)
    draw = random.Random(3)
    addresses = urls(2, 800)
    rules = {(plain(u, [])[0].split(".", draw.randint(0, 1))[-1], plain(u, [])[1][:draw.randint(0, 4)], draw.choice(["allow", "block"]))
             for u in addresses[:120]}
    check(spark, addresses, sorted(r for r in rules if r[0]))


def test_cascade_is_exact_on_the_universe(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    universe = spark.range(4000).selectExpr("concat('k', id) AS key")
    listed = spark.range(0, 6000, 7).selectExpr("concat('k', id) AS key")
    levels = urlfilter.cascade(listed, universe)
    assert len(levels) > 2
    got = {r.key for r in universe.where(urlfilter.is_listed(levels, universe["key"])).collect()}
    assert got == {f"k{i}" for i in range(0, 4000, 7)}


def test_odd_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "no scheme.org/", "x"), (None, "http://a.org/", "x"), (4, "http://", "x"),
         (4, "http://", "x"), (5, "http://...org/x", "x"), (6, "ftp://A.ORG:80/x", "x"), (7, "a://b://c.org/", None),
         (8, "http://" + "a." * 300 + "org/" + "y" * 5000, "x")], "page_id long, url string, keys string")
    rules = spark.createDataFrame([("org", "/", "block"), (None, "/", "block"), ("com", None, "block")],
                                  "host string, path string, verdict string")
    rows = urlfilter.judged(pages, rules)
    assert rows.columns == ["page_id", "url", "keys", "host", "path", "rule", "verdict"]
    got = sorted((r.page_id or 0, r.host[:8], r.verdict) for r in rows.collect())
    assert got == [(0, "a.org", "block"), (1, "", "allow"), (2, "", "allow"), (3, "", "allow"), (4, "", "allow"),
                   (4, "", "allow"), (5, "...org", "block"), (6, "a.org:80", "allow"), (7, "b:", "allow"), (8, "a.a.a.a.", "block")]
    assert urlfilter.judged(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in urlfilter.judged(pages, rules.limit(0)).collect()} == {"allow"}
