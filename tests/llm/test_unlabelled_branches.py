"""Verdicts of ``url_filter`` on branches that no rule labels, under the production rules."""

from __future__ import annotations

import random

import pytest

from graphloom.llm import url_filter


def judged(spark, urls, rules=url_filter.RULES):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {urls[r["page_id"]]: (r["rule"] is None, r["verdict"], r["purity"]) for r in url_filter.judge(df, rules).collect()}


def lower(blocked, labelled):
    n, p = labelled + 2, (blocked + 1) / (labelled + 2)
    return pytest.approx(max(0, p - url_filter.Z * (p * (1 - p) / n) ** 0.5))


def test_templates_without_labels_are_judged_by_other_hosts(spark):
    urls = [f"http://bad.net/{lang}/{i}.html" for lang in ("es", "fr") for i in range(5)] + [f"http://bad.net/{x}/1.html" for x in ("en", "de")]
    urls += [f"http://h{i}.example.com/{x}/{j}.html" for i in range(20) for x in ("en", "de") for j in range(1 + 50 * (i == 0))]
    urls += ["http://bad.net/it/1.html", "http://bad.net", "http://none.org/en/1.html", "http://none.org/it/1.html", "http://a.com/x"]
    got = judged(spark, urls)
    assert got["http://bad.net/en/1.html"] == got["http://none.org/en/1.html"] == (True, "block", lower(20, 20))  # every host once
    assert got["http://bad.net/de/1.html"] == (True, "allow", lower(0, 20))
    assert got["http://bad.net/it/1.html"] == got["http://bad.net"] == (True, "allow", 0.5)  # a host does not speak for its other branches
    assert got["http://none.org/it/1.html"] == (True, "allow", 0.5)
    assert got["http://a.com/x"][:2] == (False, "allow")


def test_few_hosts_are_no_proof(spark):
    urls = [f"http://h{i}.example.com/en/1.html" for i in range(3)] + ["http://b.net/en/2.html"]
    assert judged(spark, urls)["http://b.net/en/2.html"] == (True, "allow", lower(3, 3))


def test_random_urls_against_a_plain_tree(spark):
    rng = random.Random(4)
    rules = [("block", f"h{i}.x", f"/{a}/{b}/") for i in range(6) for a in "ab" for b in "pq" if rng.random() < 0.4]
    rules += [("allow", f"h{i}.x", f"/{a}/") for i in range(6) for a in "abc" if rng.random() < 0.4]
    urls = list({f"http://h{rng.randrange(6)}.x/{rng.choice('abc')}/{rng.choice('pqr')}/{rng.randrange(30)}" for _ in range(500)})
    got = judged(spark, urls, rules)
    for url, want in plain_tree(urls, rules).items():
        assert got[url][1] == want[0] and got[url][2] == pytest.approx(want[1])


def plain_tree(urls, rules):
    """Verdict and purity of each url by dictionaries and loops; hosts here have no subdomains and paths no single files."""
    told, split = {}, {}
    for u in urls:
        host, path = u[7:].split("/", 1)
        fits = [(len(h + p), v) for v, h, p in rules if h == host and ("/" + path).startswith(p)]
        told[u] = max(fits)[1] if fits else None
        split[u] = (host, tuple("*" if x[0].isdigit() else x for x in path.split("/")))
    count = lambda keep: [sum(1 for u in urls if keep(*split[u]) and told[u] == "block"), sum(1 for u in urls if keep(*split[u]) and told[u]),
                          sum(1 for u in urls if keep(*split[u]))]
    name = {}
    for host, segments in set(split.values()):
        parts = []
        for d in range(len(segments)):
            mine = count(lambda h, s: h == host and s[:d + 1] == segments[:d + 1])
            ours = count(lambda h, s: h == host and s[:d] == segments[:d])
            children = len({s[d] for h, s in split.values() if h == host and s[:d] == segments[:d]})
            p = (ours[0] + 1) / (ours[1] + 2)
            alike = abs((mine[0] + 1) / (mine[1] + 2) - p) <= url_filter.Z * (p * (1 - p) / max(mine[1], 1)) ** 0.5
            parts.append("**" if children > url_filter.BRANCHES and ours[2] / children < url_filter.THIN else "*-" if not mine[1] else "*+" if alike else segments[d])
        name[host, segments] = tuple(parts)
    low = lambda b, n: max(0, (b + 1) / (n + 2) - url_filter.Z * ((b + 1) / (n + 2) * (n + 1 - b) / (n + 2) / (n + 2)) ** 0.5)
    purity = {}
    for host, segments in name:
        under = lambda branch: count(lambda h, s: h == host and name[h, s][:len(branch)] == branch)  # noqa: E731, B023
        own = count(lambda h, s: h == host and name[h, s] == name[host, segments])
        hosts = [c for c in (count(lambda h, s: h == other and s == segments) for other in {h for h, _ in name}) if c[1]]
        found = [under(name[host, segments][:d]) for d in range(len(segments), -1, -1)]
        found = [c for d, c in zip(range(len(segments), -1, -1), found) if c[1] and (d or c[0] < c[1])]
        if own[1]:
            purity[host, segments] = (own[0] + 1) / (own[1] + 2)
        elif hosts:
            purity[host, segments] = low(sum(c[0] / c[1] for c in hosts), len(hosts))
        else:
            purity[host, segments] = low(*found[0][:2]) if found else 0.5
    return {u: (told[u] or ("block" if purity[split[u]] >= url_filter.REJECT else "allow"), purity[split[u]]) for u in urls}


def test_the_nearest_ancestor_counts_before_the_host(spark):
    rules = [("block", "h.org", f"/ads/{i}") for i in range(10, 40)] + [("allow", "h.org", f"/news/{i}") for i in range(10, 40)]
    urls = [f"http://h.org/{top}/{i}.html" for top in ("ads", "news") for i in range(10, 40)] + ["http://h.org/ads/new/x", "http://h.org/news/new/x", "http://h.org/other/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r["page_id"]]: r["verdict"] for r in url_filter.judge(df, rules).collect()}
    assert [got[u] for u in urls[-3:]] == ["block", "allow", "allow"]
