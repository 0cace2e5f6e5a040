import random
import re

from panelcast.llm.queries import URL_RULES
from panelcast.llm.url_filters import Rule, compiled, host_rule, judged, matched


def plain(glob):
    """The glob as a regular expression, one at a time."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.*)", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "(?s:.)", i + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out.encode("latin-1"))


def test_all_rules_at_once_equal_one_rule_at_a_time():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**", "?", "\\*"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    urls = ["".join(rng.choice("ab/.*") for _ in range(rng.randint(0, 25))).encode() for _ in range(400)]
    for some in (globs, globs[:1], globs[:40]):
        rules = [Rule(g, g, rng.random() < 0.5, rng.randint(0, 5)) for g in some]
        best = sorted(range(len(rules)), key=lambda i: (-rules[i].weight, rules[i].allow, i))
        single = [plain(g) for g in some]
        want = [next((i for i in best if single[i].fullmatch(u)), -1) for u in urls]
        assert matched(compiled(rules), urls).tolist() == want


def judge_plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for h, p, verdict in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    junk = any(w in host for w in ("casino", "pills", "adult", "bets"))
    return host, path, best and best[0], best[1] if best else "block" if junk else "allow"


def test_judged(spark):
    urls = [
        None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/en", "https://www.example.net/en/1?x=/de/", "http://example.net/en",
        "http://myexample.net/en/", "http://example.com/de/", "ftp://a.b.example.com/de/x#y", "http://example.comx/de/", "http://casino.example.com/x",
        "http://example.org/casino", "http://x.org/fr/a\nb", "http://casino", "http://É.Net/é/", "a://b://c.net/", "http://x.org?p=/fr/", "http://x.net/" + "é" * 5000,
        "http://example.net:80/en/", "http://example.net/en/", "http://example.net/en/",
    ]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(None, "http://a.net/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, URL_RULES).collect()}
    assert got == {i: judge_plain(u) for i, u, *_ in rows}
    assert judged(pages.limit(0), URL_RULES).count() == 0


def test_weights_and_ties(spark):
    rules = [Rule("a", "**x**", True, 1), Rule("b", "**y**", False, 1), host_rule("z", "/", True)]
    pages = spark.createDataFrame([(1, "h://q/xy"), (2, "h://q/x"), (3, "h://a.z/xy"), (4, "h://q/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judged(pages, rules, otherwise=False).collect()}
    assert got == {1: ("b", "block"), 2: ("a", "allow"), 3: ("z/", "allow"), 4: (None, "block")}
