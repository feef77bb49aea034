import re

import duckdb

from relspark.llm import urls
from relspark.llm.queries import URL_RULES

ORG = [("allow", "org", "/"), ("block", "bad.com", "/"), ("block", "org", "/x")]


def page(i, url, *links):
    return (i, url, "<p>" + "".join(f'<a class="c" HREF="{u}">t</a>' for u in links), "clash")


ROWS = [
    page(1, "http://A.Org/x?y", "//b.org/z"),
    page(2, "https://b.org", "http://c.net/"),
    page(3, "https://c.net/p#q", "http://c.net/self", "/rel", "http://d.net/"),
    page(4, "https://d.net", "http://bad.com/1"),
    page(5, "https://e.net/", "https://bad.com", "https://sub.BAD.com:80/x"),
    page(6, "ftp://sub.bad.com/a/b", "https://e.net"),
    page(7, None, "http://bad.com/"),
    page(8, "no host", "http://bad.com/"),
    page(9, "http://f.net?x", "http://far.net"),
    page(9, "http://f.net?x", "http://far.net"),
    (10, "http://g.net/", None, "clash"),
    page(11, "http://bad.com/"),
    page(12, "http://xbad.com/"),
]


def slow(rows, rules):
    """Scores by hand over dictionaries."""
    parsed = {}
    out = []
    for i, url, html, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2]), default=None)
        out.append((i, host, path, best))
        parsed.setdefault(host, []).append(best and best[0])
    edges = set()
    for (_, host, _, _), (_, _, html, _) in zip(out, rows, strict=True):
        for b in re.findall(r"""(?i)\shref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)""", html or ""):
            if host and host != b.lower():
                edges.add((host, b.lower()))
    scores = {}
    for kind, verdict, own in (("t", "allow", edges), ("d", "block", {(b, a) for a, b in edges})):
        seeds = {h: urls.SCALE for h, v in parsed.items() if h and 2 * v.count(verdict) >= len(v)}
        now = dict(seeds)
        for _ in range(urls.ROUNDS):
            new = {h: m * (100 - urls.DAMPING) // 100 for h, m in seeds.items()}
            for a, b in own:
                new[b] = new.get(b, 0) + (now.get(a, 0) // sum(x == a for x, _ in own)) * urls.DAMPING // 100
            now = new
        scores[kind] = now
    bad = {h for h, d in scores["d"].items() if d >= urls.THRESHOLD and d > scores["t"].get(h, 0)}
    return sorted((i, h, p, (r and r[1] + r[2]) or "", r[0] if r else "block" if h in bad else "allow") for i, h, p, r in out)


def rows_of(got):
    return sorted((r[0], r[1], r[2], r[3] or "", r[4]) for r in got)


def test_rules_and_scores(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, host string")
    got = rows_of(urls.judge(df, ORG).collect())
    assert got == slow(ROWS, ORG)
    assert {r[0] for r in got if r[4] == "block"} == {1, 2, 3, 4, 5, 6, 11}
    con = duckdb.connect()
    con.register("pages", df.drop("host").toPandas())
    assert rows_of(con.execute(urls.sql(ORG)).fetchall()) == got
    assert urls.judge(df.where("false"), ORG).count() == 0


def test_given_rules(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert rows_of(urls.judge(df, URL_RULES).collect()) == rows_of(con.execute(urls.sql(URL_RULES)).fetchall())


def settled(edges, seeds, rounds=300):
    """PageRank of a restart of 0.15 in real numbers."""
    now, degree = {}, {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    for _ in range(rounds):
        new = dict.fromkeys(seeds, 0.15)
        for a, b in edges:
            new[b] = new.get(b, 0.0) + 0.85 * now.get(a, 0.0) / degree[a]
        now = new
    return now


def test_scores_are_settled(spark):
    """Hosts that link towards blocked ones: a chain of 24, one of 7 with 9 hosts at its end, a chain with a cycle."""
    bad = ["bad.com", "one.bad.com", "two.bad.com"]
    links = [(f"{c}{i + 1}.net", f"{c}{i}.net" if i else b) for c, n, b in zip("cdg", (24, 7, 11), bad, strict=True) for i in range(n)]
    links += [(f"e{i}.net", "d7.net") for i in range(9)] + [("h0.net", "g11.net"), ("h1.net", "g11.net"), ("g1.net", "g3.net")]
    want = settled({(b, a) for a, b in links}, bad)
    pages = [(n, f"http://{a}/", f'<a href="http://{b}/">', "clash") for n, (a, b) in enumerate(links)]
    pages += [(900 + n, f"http://{b}/", None, "clash") for n, b in enumerate(bad)]
    got = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string, host string"), ORG).collect()}
    assert got == {h: "block" if d >= 0.01 else "allow" for h, d in want.items()}
    assert all(abs(d - 0.01) > 1e-4 for d in want.values())
    con = duckdb.connect()
    con.register("pages", spark.createDataFrame(pages, "page_id long, url string, html string, host string").drop("host").toPandas())
    assert {r[1]: r[4] for r in con.execute(urls.sql(ORG)).fetchall()} == got
    assert got["c16.net"] == "block" and {got["c17.net"], got["e0.net"]} == {"allow"}


def test_any_number_of_rules(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, host string")
    more = [*ORG, ("allow", "sub.bad.com", "/a"), ("block", "sub.bad.com", "/a/b/c"), ("allow", "c.net", ""), ("block", "c.net", "/p#")]
    want = slow(ROWS, more)
    assert rows_of(urls.judge(df, more).collect()) == want
    monkeypatch.setattr(urls, "MOST_RULES", 1)
    assert rows_of(urls.judge(df, more).collect()) == want
    table = spark.createDataFrame([*more, *(("block", f"x{i}.example", f"/{i}") for i in range(3000))], "verdict string, host string, path string")
    assert rows_of(urls.judge(df, table).collect()) == want
    assert urls.judge(df.where("false"), table).count() == 0


def test_equal_rules_are_decided_alike_on_either_side_of_the_limit(spark, monkeypatch):
    """Rules of one length and repeated rules: as a list, as a table and in SQL."""
    import duckdb

    rules = [("block", "b.com", "/xyz"), ("allow", "a.b.com", "/x"), ("allow", "c.com", "/x"), ("block", "c.com", "/x"), ("block", "d.com", "/"), ("allow", "d.com", "/")]
    pages = [(1, "http://a.b.com/xyz", None), (2, "http://c.com/xy", None), (3, "http://d.com/", None), (4, "http://b.com/xyz", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    listed = sorted(map(tuple, urls.judge(df, rules).collect()))
    monkeypatch.setattr(urls, "MOST_RULES", 3)
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == listed and sorted(map(tuple, urls.judge(df, rules[::-1]).collect())) == listed
    assert [(r[3], r[4]) for r in listed] == [("a.b.com/x", "allow"), ("c.com/x", "block"), ("d.com/", "block"), ("b.com/xyz", "block")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    cur = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.sql(rules)})")
    assert sorted(cur.fetchall()) == listed
