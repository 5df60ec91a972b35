from verifold.llm import urls


def plain_split(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u[u.index("://") + 3 :]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((tail.index(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_match_brute_force(spark):
    found = [
        "http://a.Example.com/en/1", "https://example.com/en/77?x", "http://example.net/de/1", "http://sub.example.net/de/88#t", "http://x.org/es/", "http://x.org/ES/", "http://com/en/",
        "http://notexample.com/en/7", "ftp://u:p@h.com:80/en/", "http://h.com?q=/en/", "http://h.com#/en/", "nothing", "", None, "http://", "://com/en/", "http://É.com/en/x", "http://a.b/c://d",
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(found)] + [(0, found[0], "x")], "page_id long, url string, verdict string")
    got = urls.judge(df).collect()
    assert len(got) == len(found) + 1
    for r in got:
        host, path = plain_split(r.url)
        rule, verdict = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r.url


def test_aliases_take_decisions_and_explicit_allow_goes_first(spark):
    link = lambda u: f'<html><LINK rel="canonical" href="{u}"></html>'
    pages = [
        (1, "http://x.org/a", link("http://x.org/es/blocked")),  # blocked by its alias
        (2, "http://x.org/es/blocked", ""),
        (3, "http://x.org/b", f"<meta http-equiv='refresh' content='0; url=http://x.org/a'>"),  # and by its alias' alias
        (4, "http://y.org/c", link("/d")),  # a component without a rule
        (5, "http://y.org/d", None),
        (6, "http://z.net/de/ok", link("http://z.org/es/no")),  # a rule of its own stands
        (7, "http://z.org/q", link("http://z.net/de/ok")),  # allowed and blocked aliases: allowed
        (8, "http://z.org/es/no", ""),
        (9, None, link("http://x.org/a")), (10, "http://x.org/a", "no link"), (11, "http://self.org/", link("http://self.org/")), (12, "http://r.org/1", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    more = spark.createDataFrame([("http://r.org/1", "http://x.org/b"), ("http://r.org/1", None)], "url string, other string")
    got = {r.page_id: r.verdict for r in urls.judge(df, redirects=more).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "block", 11: "allow", 12: "block"}


def test_empty_table_and_hot_alias(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    many = [(i, f"http://m.org/{i}", '<link rel=canonical href="http://m.org/es/x">') for i in range(300)]
    got = urls.judge(spark.createDataFrame(many, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in got} == {"block"} and len(got) == 300


def test_columns_of_any_name_are_kept(spark):
    pages = [("http://x.org/a", '<link rel=canonical href="http://x.org/es/x">', 1, 2, 3, 4, 5, 6), ("http://y.org/", None, 1, 2, 3, None, 5, 6), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(pages, "url string, html string, _r int, _own int, _node int, _alias int, root int, _own_rule int")
    for given in (df, df.drop("html"), df.where("html is null")):
        got = urls.judge(given)
        extra = ["_r", "_own", "_node", "_alias", "root", "_own_rule"]
        assert sorted(got.columns) == sorted(["url", *extra, "host", "path", "rule", "verdict"])
        assert sorted(map(str, got.select("url", *extra).collect())) == sorted(map(str, given.select("url", *extra).collect()))
    assert {r.url: r.verdict for r in urls.judge(df).collect()} == {"http://x.org/a": "block", "http://y.org/": "allow", None: "allow"}


def test_aliases_at_size(spark):
    """Chains, stars and rings of links over some thousand pages, against a union by hand."""
    import random

    rnd = random.Random(11)
    urls_ = [f"http://h{i % 50}.org/{'es/' if i % 23 == 0 else ''}{i}" if i % 5 else f"http://k{i}.net/{'de/' if i % 1000 == 0 else ''}{i}" for i in range(4000)]
    links = [(i, i + 1) for i in range(0, 600) if i % 60] + [(2000, i) for i in range(1000, 1900)] + [(i, 3000 + (i + 1) % 20) for i in range(3000, 3020)]
    links += [(rnd.randrange(4000), rnd.randrange(4000)) for _ in range(500)]
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    how = lambda b: rnd.choice(['<link rel="canonical" href="%s">', "<link href='%s' rel=canonical />", '<meta http-equiv="refresh" content="0;url=%s">']) % urls_[b]
    pages = [(i, u, "<html>" + "".join(map(how, out.get(i, []))) + "</html>") for i, u in enumerate(urls_)]
    root = list(range(4000))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    said = {}
    for i, u in enumerate(urls_):
        v = plain_rule(*plain_split(u))[1]
        said.setdefault(find(i), set()).add(v)
    want = {}
    for i, u in enumerate(urls_):
        own = plain_rule(*plain_split(u))[1]
        want[i] = own or ("allow" if "allow" in said[find(i)] else "block" if "block" in said[find(i)] else "allow")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(6)).collect()}
    assert got == want
    by_alias = sum(want[i] == "block" and plain_rule(*plain_split(u))[1] is None for i, u in enumerate(urls_))
    assert by_alias > 8


def test_sql_knows_the_links_too(spark):
    """The registered SQL over pages whose links the given tables don't have."""
    import duckdb
    import pandas as pd

    from verifold.llm.queries import OP10_SQL

    pages = [
        (1, "http://x.org/a", '<LINK rel="canonical" href="http://x.org/es/blocked">'), (2, "http://x.org/b?q", "<meta http-equiv=refresh content='0; url=/a'>"), (3, "http://x.org/f/c", "<link href=../z rel='canonical'><link rel=canonical href=d>"),
        (4, "http://x.org/f/d", '<link rel="canonical" href="//x.org/es/no">'), (5, "http://y.org", '<link rel=canonical href="es/y">'), (6, "http://z.org/q", '<link rel=canonical href="http://a.net/de/1">'),
        (7, "http://z.org/es/1", '<link rel=canonical href="http://z.org/q">'), (8, None, "<link rel=canonical href=/a>"), (9, "plain", "<link rel=canonical href=http://x.org/a>"), (10, "http://q.org/1", "<link rel=next href=http://x.org/a>"), (11, "http://q.org/2", None),
    ]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    cur = con.execute(OP10_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(dict(zip(names, r)).items() for r in cur.fetchall())
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).select(*names).collect()
    assert sorted(map(lambda r: sorted(r.items()), (x.asDict() for x in got)), key=str) == sorted((sorted(w) for w in want), key=str)
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == ["block", "block", "block", "block", "block", "allow", "block", "allow", "block", "allow", "allow"]
