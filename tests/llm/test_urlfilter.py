import random
import re

import duckdb
import numpy as np

from evenkeel.llm import queries, urlfilter
from evenkeel.llm.urlfilter import Rule


def regex(glob):
    """The glob as a regular expression over text."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = glob.index("]", i + 2 + (glob[i + 1] == "!"))
            part = glob[i + 1:end]
            out += f"(?!/)[{'^' if part[0] == '!' else ''}{part.lstrip('!')}]"
            i = end + 1
            continue
        if c == "\\":
            i += 1
            c = "\\" + glob[i]
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c[-1]))
        i += 1
    return re.compile(out, re.S)


def fits(globs, texts, words):
    found = np.zeros((len(globs), len(texts)), bool)
    for block in urlfilter.compiled(globs, words):
        for k, rows in urlfilter.matches(block, [t.encode() for t in texts]):
            found[k, rows] = True
    return found


def test_automaton_equals_regular_expressions():
    rng = random.Random(1)
    signs, parts = "ab./é漢", ["a", "b", "/", ".", "é", "*", "**", "?", "[ab]", "[!a]", "[a-c]", "\\*", "\\["]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(300)] + ["", "/" * 9, "a*b", "a[b", "ab" * 200]
    globs = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(400)] + ["", "**", "*", "ab" * 200, "a" * 70 + "**"]
    want = np.array([[regex(g).fullmatch(t) is not None for t in texts] for g in globs])
    assert want.any(1).sum() > 100
    for words in (1, 3, 64):  # globs over several words and several blocks
        assert (fits(globs, texts, words) == want).all()
    assert fits(globs, [], 64).shape == (len(globs), 0)


def brute(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for r in rules:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or (-len(r.name), r.name) < (-len(best.name), best.name)):
            best = r
    return host, path, best and best.name, best.verdict if best else default


URLS = [None, "", "://", "http://", "example.com/en/", "http://example.com", "http://example.com/en", "HTTP://EXAMPLE.com/en/x?y#z", "http://WWW.Example.Com/en/1", "https://a.www.example.com/en/#", "http://notexample.com/en/",
        "http://com/", "http://a.net/fr/", "http://a.net/x.com/en/", "http://a.net/es", "http://x.org?http://b.com/", "a://b://c.com/", "http://.com/", "http://user@b.net:80/fr/", "http://b.net./fr/", "http://bücher.com/ä\nb", "http://" + "l" * 5000 + ".com/" + "p" * 9000,
        "http://a.org/x.zip", "http://a.com/x.zip", "http://a.org/cart/2", "http://a.org/x.ZIP", "x http://q.net/fr/\n", "http://É.com/en/"]


def test_rules_equal_brute_force_and_sql(spark):
    rng = random.Random(2)
    urls = URLS + ["http://" + ".".join(rng.choice(["www", "example", "com", "net", "a"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/fr/", "/es/x", "/EN/"]) for _ in range(300)]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.com/", None), (3, urls[3], "h"), (3, urls[3], "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urlfilter.filter_urls(df, queries.URL_RULES, globs=[]).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == sorted((str(i), *[str(x) if x is None else x for x in brute(u, queries.URL_RULES, "allow")]) for i, u, _ in rows)
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    want = c.execute(queries.oracle_sql()["op11_url_automaton"]).fetchall()
    got = urlfilter.filter_urls(df, queries.URL_RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    at = {r.page_id: (r.rule, r.verdict) for r in got}
    assert at[URLS.index("http://a.org/x.zip")] == (None, "block") and at[URLS.index("http://a.com/x.zip")] == ("com/", "allow") and at[URLS.index("http://a.org/x.ZIP")] == (None, "allow")


def test_many_rules_ties_empty_and_clashing_names(spark):
    rules = [Rule("block", f"h{i}.org") for i in range(1500)] + [Rule("allow", "ab", "/c"), Rule("block", "b", "/c/")]  # ties of length: the least name
    df = spark.createDataFrame([("http://x.h1234.org/", 1, "r"), ("http://ab/c/", 2, "r"), ("http://h.org/", 3, "r")], "url string, host int, row string")
    got = {r.url: r for r in urlfilter.filter_urls(df, rules, default="ask").collect()}
    assert got["http://x.h1234.org/"].rule == "h1234.org/" and got["http://x.h1234.org/"].host == "x.h1234.org" and got["http://ab/c/"].rule == "ab/c" and got["http://h.org/"].verdict == "ask"
    whole = urlfilter.filter_urls(df, rules, nested=True)
    assert {r.row.host for r in whole.collect()} == {1, 2, 3}
    assert urlfilter.filter_urls(df.limit(0), rules).count() == 0
    assert urlfilter.filter_urls(df, [], globs=[("**h.org**", "block")]).where("verdict = 'block'").count() == 1
