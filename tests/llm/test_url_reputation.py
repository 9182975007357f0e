"""Host reputation: urls, rules, shrinkage and edge cases against a plain version."""

import math
import re

from seasoncast.llm.queries import URL_RULES
from seasoncast.llm.url_reputation import judge_pages, page_outcomes

URLS = [None, "", "no scheme/here", "http://A.Example.COM/fr/x?q#z", "https://example.org/en/1?x", "http://sub.example.org/en/2", "x://org", "x://y.org/",
        "ftp://a://b/c", "http://host.co.uk:80/p", "http://u@h.net?d", "http://b.net#f", "http://notexample.org/es/", "http://1.2.3.4/a", "http://É.com/de/é",
        "line\nhttp://n.example.com\n/p"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule(host, path):
    best = [r for r, _ in URL_RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(best, key=len) if best else None


def test_hosts_paths_rules_and_edges(spark):
    rows = [(i if i != 3 else None, u, "own") for i, u in enumerate(URLS)] + [(50, URLS[9], "own")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([(9, 0, 0), (9, 1, 0), (50, 1, 1), (None, 1, 0), (10, None, 1), (11, 1, None)], "doc_id long, quality int, toxic int")
    got = judge_pages(pages, page_outcomes(labels), URL_RULES).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=str) == sorted(((i, *split(u), rule(*split(u))) for i, u, _ in rows), key=str)
    assert all(r.verdict == dict(URL_RULES)[r.rule] for r in got if r.rule)
    assert {(r.host, r.host_labelled) for r in got if r.host_labelled} == {("host.co.uk:80", 3), ("b.net", 1)}
    none = labels.where("1 = 0")
    assert {r.host_rate for r in judge_pages(pages, page_outcomes(none)).collect()} == {0.5}
    assert judge_pages(pages.where("1 = 0"), page_outcomes(labels)).count() == 0


def test_shrinkage_orders_hosts(spark):
    rows, labels = [], []
    for host, n, good in (("bad.a.com", 30, 1), ("fine.a.com", 30, 29), ("one.a.com", 1, 0), ("x.b.net", 40, 38), ("new.b.net", 0, 0), ("new.a.com", 0, 0)):
        for k in range(max(n, 1)):
            rows.append((len(rows), f"http://{host}/{k}"))
            if n:
                labels.append((len(rows) - 1, int(k < good), 0))
    out = {r.host: r for r in judge_pages(spark.createDataFrame(rows, "page_id long, url string"),
                                          page_outcomes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    rate = {h: r.host_rate for h, r in out.items()}
    assert rate["bad.a.com"] < rate["one.a.com"] < rate["new.a.com"] < rate["fine.a.com"]
    assert rate["new.a.com"] < rate["new.b.net"]
    assert out["bad.a.com"].verdict == "block" and out["fine.a.com"].verdict == out["new.b.net"].verdict == "allow"
    assert all(math.isfinite(r.host_bound) and r.host_bound < r.host_rate for r in out.values())
