import re

import pytest

from quarry.llm import linkgraph as G

RULES = G.RULES
PAGES = [
    (1, "HTTP://WWW.Example.com/en/x?q#f", None), (2, "https://a.example.com/en/1", ""), (3, "http://b.net/es/1", '<a href="http://C.org/x">'),
    (4, "http://b.net/de/1", ""), (5, "http://c.org/1", "<a href='//b.net/es/2'><img src=https://d.org:80/i>"), (6, "http://d.org", ""),
    (7, None, None), (8, "no scheme/en/", "<a href=/x>"), (9, "", ""), (10, "x://host?a/b", ""), (11, "x://h#/en/", ""),
    (12, "http://notexample.com/en/", ""), (13, "http://b.net/fr/", ""), (14, "http://b.net/es/", ""), (14, "http://b.net/es/", ""),
    (15, "http://www.c.org/", ""), (16, "http://com/", ""), (17, "http://com", ""),
]


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    best = None
    for rule in RULES:
        name, _, p = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_hosts_paths_and_rules(spark):
    got = G.judge(pages(spark)).collect()
    assert len(got) == len(PAGES)
    url = {i: u for i, u, _ in PAGES}
    for r in got:
        assert (r.host, r.path, r.rule) == brute_rule(url[r.page_id])
        if r.rule:
            assert r.verdict == RULES[r.rule]
    by = {r.page_id: r for r in got}
    assert by[4].verdict == "block"                        # most pages of its host are blocked
    assert by[7].verdict == by[8].verdict == by[6].verdict == "allow"


def brute_mass(edges, seeds, rounds):
    start = {h: s * (1 - G.DAMPING) for h, s in seeds.items()}
    mass = dict(start)
    for _ in range(rounds):
        new = dict(start)
        for s, d, w in edges:
            if s in mass:
                new[d] = new.get(d, 0) + G.DAMPING * w * mass[s]
        mass = new
    return mass


def test_spread_is_personalised_pagerank(spark):
    edges = [("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 1.0), ("c", "c2", 1.0), ("z", "a", 1.0)]
    seeds = {"a": 2.0, "z": 1.0}
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    got = {r.host: r.mass for r in G.spread(df, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    assert got == pytest.approx(brute_mass(edges, seeds, G.ROUNDS))


def test_settled_is_the_limit(spark):
    edges = [(f"h{i}", f"h{i + 1}", 1.0) for i in range(30)] + [("h30", "h29", 0.5), ("h30", "x", 0.5), ("u", "v", 1.0), ("v", "u", 1.0)]
    seeds = {"h0": 50.0, "u": 7.0, "alone": 1.0}
    df = spark.createDataFrame(edges, "src string, dst string, w double")
    got = {r.host: r.mass for r in G.settled(df, spark.createDataFrame(list(seeds.items()), "host string, seed double")).collect()}
    want = brute_mass(edges, seeds, 400)
    assert set(got) == set(want) and sum(abs(got[h] - want[h]) for h in want) <= G.EPSILON
    assert G.settled(df, spark.createDataFrame([], "host string, seed double")).count() == 0


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(40)]
    rows += [(100 + i, f"http://c{i}.org/", f"<a href='http://{f'c{i + 1}.org' if i < 13 else 'bad.net'}/x'>") for i in range(14)]
    got = {r.page_id: r.verdict for r in G.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[100 + i] for i in range(14)} == {"block"}


def test_distrust_goes_against_links(spark):
    rows = [(i, f"http://bad.net/es/{i}", "") for i in range(20)] + [(100, "http://farm.org/x", "<a href='http://bad.net/es/1'>"),
                                                                    (101, "http://clean.org/x", ""), (102, "http://cited.org/", "")]
    rows.append((103, "http://bad.net/es/z", "<a href='http://cited.org/'>"))
    got = {r.page_id: r.verdict for r in G.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[102] == "allow"


def test_empty_tables_and_clashing_columns(spark):
    from rows import clashing
    assert G.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert G.judge(clashing(pages(spark))).count() == len(PAGES)
