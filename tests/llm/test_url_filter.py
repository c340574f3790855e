"""URL rules in both plans against brute force."""

import random
import re

import pytest

from vigil.llm import url_filter
from vigil.llm.queries import URL_PATTERNS, URL_RULES
from vigil.llm.url_filter import Rule, judge

SCHEMA = "page_id bigint, url string, host int, path int, rule int, token string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def fits(rule, host, path):
    if rule.base:
        h, slash, p = rule.text.partition("/")
        return (host == h or host.endswith("." + h)) and path.startswith(slash + p)
    return re.match("(?s)" + ".*".join(re.escape(x) for x in rule.text.split("*")), host + path) is not None


def brute(pages, rules, default="allow"):
    out = []
    for i, url in pages:
        host, path = parts(url)
        best = max(((r.base, len(r.text), r.verdict == "block", r.text) for r in rules if fits(r, host, path)), default=None)
        verdict = default if best is None or not (host or path) else "block" if best[2] else "allow"
        out.append((i, host, path, best[3] if best and best[0] else None, verdict, best[3] if best and not best[0] else None))
    return sorted(out, key=str)


def pages(seed=1):
    r = random.Random(seed)
    hosts = ["example.net", "EXAMPLE.com", "www.example.com", "a.b.org", "org", "net", "notexample.com", "example.com:80", "x.spam-farm.biz", "spam-farm.biz", "user@site.org", "h1.test", "sub.h2.test", "é.org", ""]
    paths = ["", "/", "/de/", "/de", "/DE/x", "/en/a?q=/de/", "/fr/x#y", "/casino/", "/x/casino/y", "?q=1", "#f", "/a/b/c", "/p3/x", "/p3", "//", "/de/\nline"]
    rows = [(i, f"{r.choice(['http', 'https', 'HTTP'])}://{r.choice(hosts)}{r.choice(paths)}") for i in range(300)]
    return rows + [(400, None), (401, ""), (402, "no scheme/net/"), (403, "://net/x"), (404, "a://b://org/fr/"), (405, "http://net/" + "x" * 50_000), (405, "http://net/"), (None, "http://net/"), (406, "http://net/"), (406, "http://net/")]


def many():
    rules = URL_RULES + URL_PATTERNS + [Rule("block" if i % 2 else "allow", f"h{i}.test/{'p%d/' % (i % 5) if i % 3 else ''}") for i in range(80)]
    return rules + [Rule("block", "*/p3/*", base=False), Rule("allow", "*.h2.*", base=False), Rule("block", "*b/c", base=False)]


@pytest.mark.parametrize("rules", [URL_RULES + URL_PATTERNS, many()], ids=["inline", "joined"])
@pytest.mark.parametrize("broadcast", [True, False])
def test_rules(spark, rules, broadcast, monkeypatch):
    assert (len(rules) > url_filter.INLINE) == (len(rules) > 20)
    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST", 0)
    rows = pages()
    got = judge(spark, spark.createDataFrame([(i, u, 1, 2, 3, "x") for i, u in rows], SCHEMA).repartition(3), rules)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, rules)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert judge(spark, df, many()).count() == judge(spark, df, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://net/")], "page_id bigint, url string")
    assert judge(spark, one, []).first().verdict == "allow"


def test_rarest_token_files_every_rule():
    rules = many()
    filed = url_filter.index(rules)
    assert sorted(r.text for _, r in filed) == sorted(r.text for r in rules)
    for token, rule in filed:
        assert token in rule.tokens() or not rule.tokens()
