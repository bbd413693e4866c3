import re
from itertools import product

import numpy as np
from pyspark.sql import functions as F
from rillgraph.llm import url_filter as U

PAGES = "page_id long, url string"
RULES = "host string, path string, action string"


def canon(t, every=False):
    def one(m):
        c = chr(int(m[1], 16))
        return c if (0x21 <= ord(c) < 0x7F if every else c.isascii() and (c.isalnum() or c in "-._~")) else m[0].upper()

    return re.sub("%([0-9A-Fa-f]{2})", one, t)


def decide(url, rules):
    """The rule of a URL, by trying every expression."""
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?(\[[^\]/]*\]|[^/?:]+)(?::[0-9]*)?(/[^?]*)?(\?.*)?$", re.sub(r"#.*$", "", url.strip(" "))) if url else None
    if not m or not canon(m[1], True).strip("."):
        return "allow", None
    host, path, query = canon(m[1], True).lower().strip("."), canon(m[2] or "/"), canon(m[3] or "")
    labels = host.split(".")
    hosts = {host} if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\]", host) else {host} | {".".join(labels[-k:]) for k in range(1, len(labels) + 1)}
    folders = path.split("/")
    paths = {path + query, path} | {"/".join(folders[:k]) + "/" for k in range(1, len(folders))}
    clean = [(canon(h, True).lower().strip("."), canon(p), a) for h, p, a in rules if None not in (h, p, a)]
    hits = [(len(h), len(p), a == "allow", h + p, a) for h, p, a in clean if (h, p) in set(product(hosts, paths))]
    return (max(hits)[4], max(hits)[3]) if hits else ("allow", None)


def test_against_every_expression(spark):
    r = np.random.default_rng(15)
    hosts = ["a.com", "b.a.com", "x.y.z.b.a.com", "1.2.3.4.5.6.a.com", "c.org", "C.org.", "user:pw@c.org:80", "10.2.3.4", "[::1]:8080", "%63%2Eorg"]
    paths = ["", "/", "/p", "/p/", "/p/q", "/p/q/r/s/t/u", "/p/q?x=1", "/p?x=/q/", "?z", "/p#f", "/P/", "/p/q/r/s/t/u/v/w", "/%70/%71/", "/%2F/a", "/%zz/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "https") for h in hosts for p in paths] + ["", "nothing", "://x", "http://", None, "mailto:a@c.org", " http://a.com/p "]
    choice = [(h, p, a) for h in ("a.com", "b.a.com", "B.a.com.", "5.6.a.com", "2.3.4.5.6.a.com", "c.org", "com", "3.4", "10.2.3.4", "[::1]") for p in ("/", "/p", "/%70/", "/p/q/", "/p/q?x=1", "/p/q/r/s/", "/p/q/r/s/t/u/", "/%2f/") for a in ("block", "allow")]
    for _ in range(5):
        rules = [choice[k] for k in r.choice(len(choice), 30, replace=False)] + [(None, "/", "block"), ("a.com", None, "block")]
        rules += rules[:3]
        got = U.filtered(spark.createDataFrame(list(enumerate(urls)), PAGES), spark.createDataFrame(rules, RULES)).collect()
        assert {x.page_id: (x.action, x.rule) for x in got} == {i: decide(u, rules) for i, u in enumerate(urls)}
        assert len(got) == len(urls)


def test_no_rule_is_too_deep_and_no_spelling_evades(spark):
    rules = [("a.b.c.d.e.f.g.com", "/1/2/3/4/5/6/7/", "block"), ("evil.org", "/bad/", "block"), ("test", "/", "block")]
    urls = {1: "http://x.a.b.c.d.e.f.g.com/1/2/3/4/5/6/7/8/9", 2: "http://EVIL%2eorg/%62ad/x", 3: "http://evil.org/b%41d/", 4: "http://www.test/", 5: "http://ev\til.org/bad/", 6: "http://a.b.c.d.e.f.g.com/1/2/3/4/5/6/"}
    got = {x.page_id: x.action for x in U.filtered(spark.createDataFrame(list(urls.items()), PAGES), spark.createDataFrame(rules, RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow"}


def test_odd(spark):
    pages = spark.createDataFrame([(1, "http://a.com/" + "x/" * 20_000), (1, "http://a.com/"), (1, "http://a.com/"), (None, None), (None, "http://a.com")], PAGES)
    for c in ("host", "path", "action", "rule", "_row", "_short", "_digest", "html"):
        pages = pages.withColumn(c, F.lit("own"))
    rules = spark.createDataFrame([("a.com", "/", "block")], RULES).withColumn("url", F.lit("own"))
    got = U.filtered(pages, rules).collect()
    assert sorted((x.page_id or 0, x.action) for x in got) == [(0, "allow"), (0, "block"), (1, "block"), (1, "block"), (1, "block")]


def test_empty(spark):
    none, rules = spark.createDataFrame([], PAGES), spark.createDataFrame([], RULES)
    assert U.filtered(none, U.default_rules(spark)).count() == 0
    assert U.filtered(spark.createDataFrame([(1, "http://casino-win.example.org/")], PAGES), rules).first().action == "allow"
