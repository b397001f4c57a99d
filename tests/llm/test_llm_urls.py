"""URL filters against a plain graph search with the standard library's parsers, and against SQL."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from check_queries import differences, oracle_connection  # noqa: E402

from proofspark.llm import sql, urls  # noqa: E402
from proofspark.llm.urls import Rule  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            m = re.match(r"\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"']*)", a.get("content", ""), re.I)
            self.found.append(m[1] if m else "")


def cut(url):
    if not url or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    query = rest[len(host) + len(path) :].split("#")[0][1:]
    return "".join(c.lower() if c.isascii() else c for c in host), path, query


def plain(url):
    host, path, query = cut(url)
    host = re.sub(r"\.$", "", re.sub(":(80|443)$", "", host))
    for p in ("www.", "m."):
        if host.startswith(p) and "." in host[len(p) :] and not host[len(p) :].startswith("."):
            host = host[len(p) :]
            break
    path = re.sub("/+$", "", re.sub(r"\.html?$", "", re.sub(r"/index\.(html?|php)$", "/", path)))
    query = "&".join(p for p in query.split("&") if p and not re.match("(utm_[a-z]+|ref|fbclid|gclid)(=|$)", p))
    return f"https://{host}{path}{'?' + query if query else ''}" if host else None


def ruled(url, rules):
    host, path, _ = cut(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.name), len(r.host), r.verdict == "allow"), default=None)


def expected(pages, rules, redirects=()):
    edges = set()
    for _, url, html in pages:
        if not url or "://" not in url:
            continue
        edges.add((url, plain(url)))
        parser = Links()
        parser.feed(html or "")
        for t in parser.found:
            to = urldefrag(urljoin(url, t.strip()))[0] if t.strip() and not t.strip().startswith("#") else ""
            if re.match("(?i)https?://[^/?]", to):
                edges.add((url, to))
    edges |= set(redirects)
    edges |= {(u, plain(u)) for e in edges for u in e if u}
    near = defaultdict(set)
    for a, b in edges:
        verdicts = [getattr(ruled(x, rules), "verdict", None) for x in (a, b) if x]
        if a and b and a != b and "allow" not in verdicts:
            near[a].add(b)
            near[b].add(a)
    todo = [u for u in near if getattr(ruled(u, rules), "verdict", None) == "block"]
    blocked = set(todo)
    while todo:
        for v in near[todo.pop()] - blocked:
            blocked.add(v)
            todo.append(v)
    out = []
    for i, url, _ in pages:
        r = ruled(url, rules)
        verdict = r.verdict if r else "block" if url in blocked else "allow"
        by = "rule" if r else "alias" if url in blocked else "default"
        out.append((i, *cut(url)[:2], r.name if r else None, verdict, by))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "by").collect()), key=str)


def test_matches_sql(spark):
    ours = urls.op11_url_filters(spark, FOLDER).toPandas()
    assert differences(ours, oracle_connection(FOLDER).execute(sql.URL_FILTERS).df()) is None


EDGE = [
    (1, "http://spam.example.com/de/1", None),
    (2, "http://a.net/x", '<link rel="canonical" href="http://spam.example.com/de/1">'),
    (3, "http://b.net/y", "<META HTTP-EQUIV=Refresh CONTENT='0; URL=http://a.net/x#top'>"),
    (4, "https://www.a.net/x/index.html?utm_source=f#c", ""),
    (5, "http://good.com/fr/1", '<link href="http://spam.example.com/de/2" rel="nofollow canonical">'),
    (6, "http://c.net/z", '<link rel=canonical href=http://good.com/fr/1>'),
    (7, "http://d.net/dir/page?q=1", '<link rel="canonical" href="../de/./x/">'),
    (8, "http://e.com/q/w", '<link rel="canonical" href="/de/2&amp;a=1">'),
    (9, "http://f.net/", '<!-- <link rel="canonical" href="http://spam.example.com/de/1"> --><script>"<link rel=canonical href=http://e.com/de/>"</script>'),
    (10, "http://g.net", '<link rel="canonical" href="#x"><link rel="canonical" href=""><link rel="canonical" href="mailto:a@b.c">'),
    (11, "no scheme", '<link rel="canonical" href="http://e.com/de/">'),
    (12, None, '<link rel="canonical" href="http://e.com/de/">'),
    (13, "", None),
    (None, "HTTP://EXAMPLE.ORG/en/12?x", None),
    (14, "http://example.org", None),
    (15, "http://sub.example.org/es/", "x" * 200_000 + '<link rel="canonical" href="//a.net/q">'),
    (16, "http://a.net/q", None),
    (16, "http://a.net/q", None),
    (17, "http://x/?u=http://y.com/de/", None),
    (18, "http://h.com/d?a=1&ref=2#f", '<link rel="canonical" href="?b=2">'),
    (19, "http://h.com/d?b=2", '<link rel="canonical" data-href="/de/" href="e/../../de/x">'),
    (20, "http://m.com/de", None),
]


def test_edge_cases(spark):
    df = spark.createDataFrame(EDGE, PAGES).withColumns({"verdict": F.lit("?"), "Host": F.lit("?")})
    out = urls.filter_urls(df)
    assert got(out) == expected(EDGE, urls.RULES)
    verdicts = {r.page_id: r.verdict for r in out.collect()}
    assert [verdicts[i] for i in (2, 3, 4)] == ["block"] * 3  # over two links and a variant
    assert (verdicts[5], verdicts[6], verdicts[9], verdicts[14]) == ("allow",) * 4  # an allow stops it


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_equal_search(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.com", "www.a.com", "m.b.example.org", "example.org", "c.net", "x.example.com"]
    address = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.randint(1, 40)}{rng.choice(['', '/', '.html', '#x', '?ref=1', '?p=2'])}"
    pages = [(i, address(), rng.choice(["", f'<link rel="canonical" href="{address()}">', f'<meta http-equiv="refresh" content="1;url={address()}">'])) for i in range(250)]
    redirects = [(address(), address()) for _ in range(30)] + [(None, address()), (address(), None)]
    rules = [Rule("block", "a.com", "/de/1"), Rule("allow", "a.com", "/de/11"), Rule("block", "example.org", "/"), Rule("allow", "b.example.org", "/fr/"), Rule("block", "net", "/en/7")]
    df = spark.createDataFrame(pages, PAGES)
    given = spark.createDataFrame(redirects, "from_url string, to_url string")
    want = expected(pages, rules, [r for r in redirects if all(r)])
    assert got(urls.filter_urls(df, rules, given)) == want
    assert len({r[4:] for r in want}) == 4


def test_a_hot_hub_and_a_long_chain(spark):
    pages = [(i, f"http://h{i}.net/", '<link rel="canonical" href="http://hub.net/p">') for i in range(3000)]
    pages += [(5000 + i, f"http://chain.net/{i}", f'<link rel="canonical" href="/{i + 1}">') for i in range(60)]
    pages += [(6000, "http://hub.net/p", '<meta http-equiv="refresh" content="0;url=http://chain.net/0">')] + [(7000, "http://same.net/", None)] * 500
    rules = [Rule("block", "chain.net", "/60")]
    assert got(urls.filter_urls(spark.createDataFrame(pages, PAGES), rules)) == expected(pages, rules)


def test_rule_ties_empty_table_and_no_python(spark):
    rules = [Rule("block", "b.a.com", "/x"), Rule("allow", "a.com", "/x/y"), Rule("block", "a.com", "/q"), Rule("allow", "a.com", "/q")]
    pages = [(1, "http://b.a.com/x/yz", ""), (2, "http://c.a.com/q", "")]
    assert got(urls.filter_urls(spark.createDataFrame(pages, PAGES), rules)) == expected(pages, rules)
    out = urls.filter_urls(spark.createDataFrame([], PAGES))
    assert out.count() == 0
    plan = urls.op11_url_filters(spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        urls.rule_of(F.col("h"), F.col("p"), [Rule("block", str(i), "/") for i in range(urls.MOST_RULES + 1)])
