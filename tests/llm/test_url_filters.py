import random

from logtide.llm import oracle, url_filters
from logtide.llm.queries import URL_RULES

from .conftest import rows_of

URLS = ["http://a.net", "http://a.net/", "HTTP://EXAMPLE.net/en/x?y#z", "https://example.net/en", "x://b.example.com/de/1",
        "http://example.com:80/de/", "ftp://org/fr/", "http://notorg/fr/", "http://deep.a.b.c.org/fr/q/r?s=/de/", None, "",
        "no scheme", "http://", "http:///net/", "http://net?x/", "http://net/#a", "http://ÄEXAMPLE.NET/en/",
        "a://b://example.net/en/", "http://example.net/EN/", "http://x.example.com/de/\nline", "http://net./x",
        "http://" + "a." * 3000 + "net/" + "p/" * 3000]


def pages(spark, urls, extra=True):
    return spark.createDataFrame([(i, u, "<p>", "h", "p", "r", "v", "k") for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, path string, rule string, "
                                 "verdict string, key_0 string")


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def test_contract_rules_against_brute_force_and_sql(spark, duck):
    df = pages(spark, URLS + URLS[:3])  # repeated urls
    got = url_filters.filter_urls(df, url_filters.rule_table(spark, URL_RULES)).toPandas()
    want = sorted((i, *brute(u, URL_RULES)) for i, u in enumerate(URLS + URLS[:3]))
    assert sorted(got[["page_id", "host", "path", "rule", "verdict"]].where(got.notna(), None)
                  .itertuples(index=False, name=None)) == want
    assert rows_of(got) == duck(oracle.OP1, pages=df.select("page_id", "url").toPandas())


def test_random_rules(spark):
    rng = random.Random(4)
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in
                  ((".".join(rng.choices("abc", k=rng.randint(1, 3))), rng.choice(["", "/", "/a", "/a/", "/a/b", "/b/a/"]))
                   for _ in range(25))}.values())
    urls = ["h://" + ".".join(rng.choices("abc", k=rng.randint(1, 5))) + "/" * rng.randint(0, 1)
            + "/".join(rng.choices(["a", "b", "ab"], k=rng.randint(0, 4))) for _ in range(300)]
    got = url_filters.filter_urls(pages(spark, urls), url_filters.rule_table(spark, rules)).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == {
        (i, *brute(u, rules)[2:]) for i, u in enumerate(urls)}


def test_equal_rules_block_wins_and_empty_tables(spark):
    both = url_filters.rule_table(spark, [("a", "/", "allow"), ("a", "/", "block"), ("a", "/", "allow")])
    one = pages(spark, ["http://a/"])
    assert [r.verdict for r in url_filters.filter_urls(one, both).collect()] == ["block"]
    none = url_filters.rule_table(spark, [])
    assert [(r.rule, r.verdict) for r in url_filters.filter_urls(one, none).collect()] == [(None, "allow")]
    assert url_filters.filter_urls(one.limit(0), both).count() == 0


def test_no_python_in_the_plan(spark):
    plan = url_filters.filter_urls(pages(spark, URLS), url_filters.rule_table(spark, URL_RULES)
                                   )._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
