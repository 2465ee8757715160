import random
import re

from ragloom.llm import components, urlfilter


def plain(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    key = re.sub(r"^www\.", "", host) + re.sub(r"(/|\.html)$", "", path) if host else None
    return host, path, rule.name if rule else None, rule.verdict if rule else "block" if key is not None and key in listed else "allow"


def urls():
    r = random.Random(2)
    hosts = ["example.net", "a.example.net", "EXAMPLE.com", "x.example.com", "notexample.com", "fr.org", "org", "www.site.edu", "site.edu", "net", "ünï.test"]
    paths = ["", "/", "/en/", "/en/a", "/de/b.html", "/fr/", "/fr", "/c/d/", "/x?q=://y", "#f", "?a/b"]
    out = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    return out + [None, "", "no scheme", "://", "http://", "http:///en/", out[0], out[0]]


def test_against_plain_version_by_broadcast_and_by_block(spark, monkeypatch):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "c", 1) for i, u in rows], "page_id long, url string, canonical string, bits int")
    listed = {"site.edu/c/d", "site.edu", "notexample.com/en", "never.seen", "ünï.test/fr"}
    for limit in (urlfilter.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(urlfilter, "BROADCAST_BLOCKS", limit)
        for some in (listed, set()):
            table = spark.createDataFrame([(x,) for x in some] + [(None,), *[(x,) for x in list(some)[:2]]], "canonical string")
            got = sorted(tuple(x) for x in urlfilter.judge(pages, table).select("page_id", "host", "path", "rule", "verdict").collect())
            assert got == [(i, *plain(u, some)) for i, u in rows]
    assert urlfilter.judge(pages.limit(0), urlfilter.listed_pages(pages.limit(0))).collect() == []


def test_components_of_chains_hubs_and_repeated_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(201, 200), (200, 201), (7, 7), (159, 300)]
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200: 200, 201: 200, 300: 100}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
