"""URL rules against every rule tried on every URL."""

import random

from conftest import SF_DIR
from tidemark.llm import url_filter as uf
from tidemark.llm.queries import URL_RULES, op4_url_filter


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:end]


def judge(url, rules):
    host, path = split_url(url)
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    _, verdict, rule = max(fits)
    return host, path, rule, verdict


def test_query_against_every_rule(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert sorted(map(tuple, op4_url_filter(spark, SF_DIR).collect()), key=str) == sorted(((p.page_id, *judge(p.url, URL_RULES)) for p in pages), key=str)


def test_nested_rules_and_odd_urls(spark):
    rng = random.Random(1)
    labels, parts = ["a", "b", "example", "org", "com", "é"], ["/", "/a", "/a/", "/a/b", "/en/1", "", "/ab"]
    rules = list({(".".join(rng.choice(labels) for _ in range(rng.choice([1, 1, 2, 3]))), rng.choice(parts)): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.choice([1, 2, 3, 4]))) + rng.choice(parts) + rng.choice(["", "?q=/a", "#x", "/z", "c"]) for _ in range(500)]
    urls += [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/A", "x://org", "://org/", "a://b://c", "http://..org/", "http://org:80/", "http://\x01/\n/x"]
    urls += ["http://a.example.org/a/b"] * 300
    rows = [(i if i % 50 else None, u, "r") for i, u in enumerate(urls)] + [(3, urls[3], "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    want = sorted(((i, *judge(u, rules)) for i, u, _ in rows), key=str)
    for given in (rules, spark.createDataFrame([(*r, 1) for r in rules + rules[:3]], "host string, path string, verdict string, n int")):
        for ranges in (1, 7):
            assert sorted(map(tuple, uf.match_urls(pages, given, ranges=ranges).collect()), key=str) == want
    both = uf.match_urls(pages.limit(20), [("org", "/", "allow"), ("org", "/", "block")]).where("rule is not null")
    assert {r.verdict for r in both.collect()} <= {"block"}
    assert {r.verdict for r in uf.match_urls(pages, []).collect()} == {"allow"}
    assert uf.match_urls(pages.limit(0), rules).count() == 0
