import fnmatch
import random
import re

from graphloom.llm import queries
from graphloom.llm.url_filter import GlobAutomaton, Rule, canonical, judge_urls


def glob_regex(p):
    out, quoted = "", False
    for c in p:
        if quoted or c not in "*?\\":
            out, quoted = out + re.escape(c), False
        elif c == "\\":
            quoted = True
        else:
            out += ".*" if c == "*" else "."
    return re.compile(out, re.S)


def test_against_regular_expressions():
    rng = random.Random(3)
    patterns = ["", "*", "?", "a", "a*", "*a", "a*b", "*ab*", "**a?b", "\\*a", "a\\?*"] + ["".join(rng.choice("ab*?") for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts = ["".join(rng.choice("ab*?") for _ in range(rng.randrange(12))) for _ in range(400)]
    got = GlobAutomaton(p.encode() for p in patterns).fits([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            assert got[i, j] == bool(glob_regex(p).fullmatch(t)), (t, p)
    assert fnmatch.fnmatchcase("ab", "a*")


def test_canonical():
    assert canonical("HTTP://A.B.Com/X?y#z") == ("a.b.com", "/X")
    assert canonical("x://É.com?/q") == ("É.com", "")
    assert canonical("x://h#a/b") == ("h", "") and canonical("nothing") == ("", "") and canonical(None) == ("", "")


def test_rows(spark):
    rules = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7")]
    urls = ["http://a.example.com/en/70", "http://example.com/en/6", "http://com/en/", "http://xcom/en/", "http://x.org/.com/en/", None, "", "http://b.com/EN/", "http://a.example.com/en/70"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = sorted(judge_urls(df, rules).collect())
    assert [r["verdict"] for r in rows] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert [r["rule"] for r in rows] == ["example.com/en/7", "com/en/", "com/en/", None, None, None, None, None, "example.com/en/7"]
    assert judge_urls(df.limit(0), rules).count() == 0 and judge_urls(df, []).filter("verdict = 'allow'").count() == 9


def test_globs_where_no_rule_fits(spark):
    assert GlobAutomaton([*(r.glob for r in queries.URL_RULES), *(g.glob for g in queries.URL_GLOBS)]).words > 3
    urls = [u for host in ("spam-x.org", "a.cheap-y.net", "xcheap-y.net", "m.example.com", "casino", "a.xn--b.top") for u in (f"http://{host}/ads/1", f"http://{host}/x.exe", f"http://{host}/de/8", f"http://{host}/a/print/b", f"http://{host}/session9/x", f"http://{host}", f"http://{host}/ok?/ads/")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in judge_urls(df, queries.URL_RULES, queries.URL_GLOBS).collect():
        bad = any(glob_regex(g.host).fullmatch("." + r["host"]) and glob_regex(g.path).fullmatch(r["path"]) for g in queries.URL_GLOBS)
        assert r["rule"] or r["verdict"] == ("block" if bad else "allow"), r
