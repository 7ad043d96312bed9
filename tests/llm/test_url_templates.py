import duckdb

from formlens.llm import url_templates
from formlens.llm.queries import op9_url_templates
from formlens.llm.url_templates import UrlRule, judge, merged, templates


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    return sorted(con.execute(url_templates.ORACLE_SQL).fetchall(), key=str)


def test_parts_and_rules(spark):
    rows = [(0, None), (1, "no scheme/en/"), (2, "HTTP://M.Example.COM/en/1?x#y"), (3, "http://a.www.example.com/en/1"), (4, "x://net/es/"), (5, "x://notnet/es/"), (6, "x://a.net#/es/"), (7, "x://É.Net/fr/1"), (8, "a://b://c.com/"), (9, "x://com"), (10, "x://h.org/" + "s/" * 3000), (10, "x://h.org/a/b"), (None, "http://q.com?/en/")]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in rows], "page_id long, url string, Host string")
    got = sorted((tuple(r) for r in judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == oracle(rows)
    of = {r[0]: r[1:4] for r in got}
    assert of[0] == of[1] == ("", "", None) and of[2] == ("m.example.com", "/en/1", "example.com/en/")
    assert of[3][2] == "www.example.com/en/" and of[4][2] == "net/es/" and of[5][2] is None and of[6] == ("a.net", "", None)
    assert of[7][:2] == ("É.net", "/fr/1") and of[8] == ("b:", "//c.com/", None) and of[9][1:] == ("", None)
    assert judge(pages.limit(0)).count() == 0


def test_templates_are_learned(spark):
    rules = (UrlRule("h.net", "/bad/x", "block"), UrlRule("h.net", "/good/x", "allow"))
    urls = [f"http://h.net/{kind}/{'x' if k % 2 else 'y'}{k}/{chr(97 + k % 26)}slug" for kind in ("bad", "good") for k in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in judge(pages, rules).collect():
        assert r.verdict == ("block" if "/bad/" in r.url else "allow"), r.url


def test_wide_branches(spark):
    rows = [(i, f"http://h{i % 3}.{('com', 'net', 'org')[i % 3]}/{('en', 'es', 'fr')[i % 7 % 3]}/topic-{chr(97 + i % 23)}{chr(97 + i % 19)}/p{i}") for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert sorted((tuple(r) for r in judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == oracle(rows)


def test_copies_have_no_weight(spark):
    urls = [f"http://{h}/{lang}/{k}" for h in ("a.net", "b.example.net", "c.example.com") for lang in ("en", "es", "fr", "de") for k in ("one", "two", "three")]
    told = []
    for times in (1, 5, 30):
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * times)], "page_id long, url string")
        told.append({r.url: r.verdict for r in judge(pages).collect()})
    assert told[0] == told[1] == told[2]
    assert told[0]["http://a.net/de/one"] == "allow"  # though all that is labelled on this host is blocked


def test_other_hosts_never_block(spark):
    """A template that is blocked on many hosts stays allowed on one without labels; on a labelled one its own labels decide."""
    rules = (UrlRule("bad.net", "/ads/", "block"), UrlRule("own.org", "/ads/x", "block"), UrlRule("good.com", "/", "allow"))
    urls = [f"http://{h}/ads/{'x' if k % 2 else 'y'}{k}" for h in ("a.bad.net", "b.bad.net", "c.bad.net", "own.org", "free.org") for k in range(60)]
    urls += [f"http://good.com/{d}/{k}" for d in ("news", "about") for k in range(60)] + [f"http://own.org/news/{k}" for k in range(60)]
    got = {r.url: r.verdict for r in judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for url, verdict in got.items():
        assert verdict == ("block" if "bad.net" in url or "own.org/ads" in url else "allow"), url


def test_generated_hosts_without_labels_are_allowed(spark):
    got = op9_url_templates(spark, "/root/testdata/sf0.01").collect()
    labelled = {r.host for r in got if r.rule}
    free = [r for r in got if r.host not in labelled]
    assert len(free) > 20 and {r.verdict for r in free} == {"allow"}


def test_what_follows_a_wildcard_is_generalised_together(spark):
    rows = [("h", ["u", f"name{k}", f"slug{k}"], 1) for k in range(2000)] + [("h", ["u"], 1)]
    shapes = spark.createDataFrame(rows, "host string, shape array<string>, n long")
    got = templates(shapes, 5, 20, 0.05).select("template").distinct().collect()
    assert sorted(r.template for r in got) == [["u"], ["u", "*", "*"]]


def test_like_siblings_are_merged(spark):
    tree = [(0, "", None, 300, 100), (1, "good", "", 280, 3), (1, "better", "", 10, 0), (1, "bad", "", 2, 60), (1, "worse", "", 0, 30), (1, "odd", "", 8, 7), (1, "none", "", 0, 0)]
    got = {r.node: (r.allowed, r.blocked) for r in merged(spark.createDataFrame(tree, "depth int, node string, parent string, allowed long, blocked long"), [], 1.96).collect()}
    assert got["bad"] == got["worse"] == (2, 90)  # one branch
    assert got["odd"] == (8, 7) and got["none"] == (0, 0) and got[""] == (300, 100)
