import re
import random

from helpers import SF, rows
from oracle import connect, differences

from veridoc.llm import urlfilter as U
from veridoc.llm.queries import oracle_sql, queries


def test_query_is_its_sql(spark):
    assert differences(queries()["op1_url_filter"](spark, SF), oracle_sql()["op1_url_filter"], connect()) == ([], [])


def test_hard_urls(spark):
    urls = [None, "", "x", "http://", "HTTP://COM/en/", "a://b://c/d", "http://Www.Example.COM/en/7x?q", "http://example.com/EN/7", "http://xcom/en/a", "http://com/en/", "http://com/en", "http://a.com:80/en/", "http://a.net\n/de/8", "http://é.example.net/de/8#f", "http://example.net/de/81", "http://www.cheap-pills.example.fr/", "http://archive.example.org/popunder/x", "http://h/a.exe", "http://h/a.exe?x"]
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, tokens int")
    got = {r["page_id"]: r for r in U.judge(df, U.default_rules()).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = "", ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        best = None
        for text, verdict in U.SITE_RULES:
            h, _, p = text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (-len(text), text) < (-len(best[0]), best[0])):
                best = (text, verdict)
        assert got[i]["rule"] == (best[0] if best else None), u
        if best:
            assert got[i]["verdict"] == best[1]
    assert got[urls.index("http://www.cheap-pills.example.fr/")]["verdict"] == "block"
    assert got[urls.index("http://archive.example.org/popunder/x")]["verdict"] == "allow"
    assert [got[urls.index(u)]["verdict"] for u in ("http://h/a.exe", "http://h/a.exe?x")] == ["block", "allow"]
    assert rows(U.judge(df.limit(0), U.default_rules())) == []
    assert {r["verdict"] for r in U.judge(df, []).collect()} == {"allow"}


def test_many_rules_against_all_regexes(spark):
    draw = random.Random(3)
    words = ["ads", "track", "img", "news", "shop", "x1", "cdn", "blog"]
    texts = {draw.choice(["||", "|https://", "/", ""]) + draw.choice(words) + draw.choice(["^", "*", ".", "-"]) + draw.choice(words) + draw.choice(["^", "/", "", "|"]) for _ in range(60)}
    rules = [U.pattern_rule(t, draw.choice(["allow", "block"])) for t in sorted(texts)]
    urls = [f"https://{draw.choice(words)}.{draw.choice(words)}.com/{draw.choice(words)}{draw.choice(['/', '-', '.'])}{draw.choice(words)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = U.judge(df, rules).collect()
    for r in got:
        fits = [x for x in rules if re.search(x.regex.replace(r"\z", r"\Z"), urls[r["page_id"]])]
        assert r["verdict"] == ("allow" if any(x.verdict == "allow" for x in fits) or not fits else "block")
    assert max(r["n_tried"] for r in got) < len(rules)


def test_no_python_on_executors(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://a")], "page_id long, url string"), U.default_rules())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
