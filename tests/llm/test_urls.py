"""Hosts, paths and rules against plain string work; the template tree against plain dictionaries."""

import math
import re
from collections import defaultdict

import pytest

from creditlens.llm import urls
from creditlens.llm.urls import judge

from .conftest import SF

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = [r for r in rules for name, _, start in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    return max(fits, key=lambda r: (len(r), r), default=None)


def typed(s):
    stem, ext = re.fullmatch(r"(?s)(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?", s).groups()
    form = None
    if re.fullmatch("[0-9]+", stem):
        form = "{number}"
    elif re.fullmatch("[0-9a-fA-F-]{8,}", stem) and re.search("[0-9]", stem):
        form = "{hex}"
    elif re.fullmatch("[0-9A-Za-z_-]{12,}", stem) and re.search("[0-9]", stem) and re.search("[A-Za-z]", stem):
        form = "{id}"
    return form + (ext or "") if form else s


def brute(rows, rules):
    """(page_id, host, path, rule, verdict, template, purity) of (page_id, url, label) rows."""
    pages = []
    for i, url, label in rows:
        host, path = split(url)
        pages.append((i, host, path, tuple(typed(s) for s in path.removeprefix("/").split("/", urls.DEPTH - 1)), label))
    shape = {(h, s): () for _, h, _, s, _ in pages}
    for k in range(urls.DEPTH):
        c = defaultdict(lambda: defaultdict(int))
        for _, h, _, s, _ in pages:
            if k < len(s):
                c[h, shape[h, s]][s[k]] += 1
        for (h, s), old in list(shape.items()):
            if k < len(s):
                kinds = c[h, old]
                rare = len(kinds) >= urls.LEAST_KINDS and kinds[s[k]] * len(kinds) < urls.FREQUENT * sum(kinds.values())
                shape[h, s] = old + ("*" if rare else s[k],)
    tree = defaultdict(lambda: [0, 0])
    for _, h, _, s, label in pages:
        t = tree[h, shape[h, s]]
        t[0] += label == 1
        t[1] += label is not None
    merged = {k: () for k in tree}
    for k in range(urls.DEPTH):
        branch = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for (h, s), (g, n) in tree.items():
            if k < len(s):
                b = branch[h, merged[h, s]][s[k]]
                b[0], b[1] = b[0] + g, b[1] + n
        for (h, s), old in list(merged.items()):
            if k < len(s):
                sib = branch[h, old]
                pg, pn = map(sum, zip(*sib.values()))
                g, n = sib[s[k]]
                far = bool(pn) and abs(g - n * (pg / pn)) > urls.SIMILAR * math.sqrt(n * (pg / pn) * (1 - pg / pn))
                merged[h, s] = old + ("~" if len(sib) > 1 and not far else s[k],)
    total, hosts, leaves = [0, 0], defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, s), (g, n) in tree.items():
        for x in (total, hosts[h], leaves[h, merged[h, s]]):
            x[0], x[1] = x[0] + g, x[1] + n
    smooth = lambda x, prior: (x[0] + urls.SMOOTHING * prior) / (x[1] + urls.SMOOTHING)
    out = []
    for i, h, path, s, _ in pages:
        m = merged[h, shape[h, s]]
        purity = smooth(leaves[h, m], smooth(hosts[h], total[0] / total[1] if total[1] else 0.0))
        rule = rule_of(h, path, rules)
        verdict = rules[rule] if rule else "block" if total[1] and purity < urls.LEAST_PURITY else "allow"
        out.append((i, h, path, rule, verdict, "/" + "/".join(m), pytest.approx(purity, rel=1e-9)))
    return out


def check(spark, rows, labels, rules=RULES):
    df = spark.createDataFrame([(i, u, "host", "path") for i, u in rows], "page_id long, url string, host string, label string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = sorted((tuple(r) for r in judge(df, marks, rules).collect()), key=lambda r: repr(r[:6]))
    by_id = dict(labels)
    wanted = sorted(brute([(i, u, by_id.get(i) if i is not None else None) for i, u in rows], rules), key=lambda r: repr(r[:6]))
    assert got == wanted
    return {r[0]: r for r in got}


def test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "cast(quality as int)").collect()
    check(spark, [tuple(r) for r in pages], [tuple(r) for r in labels])


def test_odd_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://x.example.net/en/1", "x://example.net/en", "http://notexample.net/en/", "http://EXAMPLE.com/de/a?b#c", "http://example.com#/de/", "http://é.ORG/fr/ü", "a://b://c/d", "http://h/a\nb/c?x", "http://org//fr/", "http://org/fr/", "http://h/1/2/3/4/5/6/7/8/9", "://x/y", "http://user@h:80/p"]
    rows = list(enumerate(odd)) + [(None, "http://org/fr/x"), (1, "http://org/fr/"), (1, "http://org/fr/")]
    check(spark, rows, [(3, 1), (5, 0), (15, 1)])
    check(spark, rows, [])
    check(spark, [], [])


def test_learnt_templates(spark):
    rows, labels = [], []
    for k in range(60):
        for name, good in (("spam", 0), ("news", 1), ("blog", 1)):
            i = len(rows)
            rows.append((i, f"http://site.test/{name}/{'word' + chr(97 + k % 26) * (k // 26 + 1)}/{k}.html"))
            if k % 2:
                labels.append((i, good))
    got = check(spark, rows, labels)
    assert all((r[4] == "block") == (r[2].startswith("/spam/")) for r in got.values())
    assert {r[5] for r in got.values()} == {"/spam/*/{number}.html", "/news/*/{number}.html", "/blog/*/{number}.html"} or len({r[5] for r in got.values()}) == 2


def test_deep_paths(spark):
    """Branches below the sixth segment, and below the twentieth, have templates and verdicts of their own."""
    for above in ("a/b/c/d/e", "/".join("abcdefghijklmnopqrst")):
        rows, labels = [], []
        for k in range(60):
            for name, good in (("spam", 0), ("news", 1), ("blog", 1)):
                rows.append((len(rows), f"http://site.test/{above}/{name}/{k}"))
                labels.append((rows[-1][0], good))
        rows.append((len(rows), "http://site.test/" + "x/" * 22))
        got = check(spark, rows, labels)
        assert all((r[4] == "block") == ("/spam/" in r[2]) for r in got.values())
        assert got[0][5].endswith("/spam/{number}") and got[0][5].count("/") == above.count("/") + 3
