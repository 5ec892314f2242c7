import random

from raritas.llm import url_filter
from raritas.llm.url_filter import RULES, Rule, judge_urls


def by_force(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best.name if best else None, best.verdict if best else default


def check(spark, urls, rules, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = judge_urls(pages, rules, **options).collect()
    assert {r.page_id: tuple(r)[1:] for r in out} == {i: by_force(u, rules) for i, u in enumerate(urls)}


URLS = ["http://a.example.net/en/x", "https://EXAMPLE.NET/en", "http://example.net", "http://net/", "http://x.org/fr/y?z", "http://org/fr#a", "http://notexample.com/de/", "http://example.com/de/1", "no url", "", None, "http://example.net:80/en/", "a://b://c/d", "http://İ.net/", "http://.net/", "http://example.com./de/", "http://example.net?/en/", "http://x.net\n/en/"]


def test_given_rules(spark):
    check(spark, URLS, RULES)
    check(spark, URLS, RULES, trie_rules=0)


def test_random_rules(spark):
    draw = random.Random(4)
    label, segment = (lambda: draw.choice("abc")), (lambda: draw.choice(["", "p", "pq", "q"]))
    rules = [Rule(draw.choice(["allow", "block"]), ".".join(label() for _ in range(draw.randrange(1, 4))), "/" + "/".join(segment() for _ in range(draw.randrange(3)))) for _ in range(60)]
    rules.append(Rule("block", "a.b", ""))
    urls = [f"http://{'.'.join(label() for _ in range(draw.randrange(1, 5)))}{''.join('/' + segment() for _ in range(draw.randrange(4)))}" for _ in range(600)]
    check(spark, urls, rules)
    check(spark, urls, rules, trie_rules=0)


def test_odd_tables(spark):
    pages = spark.createDataFrame([(None, "http://x.net/", 1), (None, "http://x.net/", 1)], "page_id long, url string, verdict int")
    assert [tuple(r) for r in judge_urls(pages, RULES).collect()] == [(None, "x.net", "/", "net/", "block")] * 2
    assert judge_urls(pages.limit(0), RULES).isEmpty()
    assert [r.verdict for r in judge_urls(pages, [], default="block").collect()] == ["block"] * 2


def test_very_long_urls(spark):
    import time

    long_segment, many = "a" * 2_000_000, "/a" * 300_000
    urls = [f"https://x.net/{long_segment}", f"https://x.net{many}", f"https://www.org/fr/{long_segment}", f"https://{long_segment}.net/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    started = time.time()
    for trie_rules in (url_filter.TRIE_RULES, 0):
        out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.RULES, trie_rules=trie_rules).collect()}
        assert out == {0: ("net/", "block"), 1: ("net/", "block"), 2: ("org/fr/", "allow"), 3: ("net/", "block")}
    assert time.time() - started < 60
