import random

import pytest

from tidemark.llm.url_filter import DigestIndex, judge_urls, write_index


def brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    top = max(f[:2] for f in fits)
    return host, path, max(fits)[2], "block" if any(f[:2] == top and f[3] == "block" for f in fits) else "allow"


@pytest.mark.parametrize("limit", [1000, 42, 41, 0])
def test_against_brute_force(spark, limit):
    rng = random.Random(limit)
    labels, paths = ["a", "b", "com", "net", "x-y", "é"], ["/", "/e/", "/en/", "/en/x", "", "/E/"]
    rules = [(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(40)]
    rules += [("", "/e/", "block"), ("", "/en/", "allow")]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{'.'.join(rng.choice(labels + ['COM']) for _ in range(rng.randrange(1, 5)))}{rng.choice(paths)}{rng.choice(['', 'q.html', '?u=http://z/en/', '#t'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "x://a.com", "a?b://com/e/", "http://com\n/en/", "http://.com/", "http://com./", "http://com./e/", "http:///en/x", "http://a..com/e/", "http://a.com./en/", "http://./e/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, table, max_index_rules=limit).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_rules_and_collisions(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert judge_urls(df, []).first()["verdict"] == "allow"
    assert judge_urls(df.limit(0), []).count() == 0
    import tidemark.llm.url_filter as m

    monkeypatch.setattr(m.xxhash, "xxh64_intdigest", lambda s, seed=0: len(s) % 2)  # nearly all keys collide
    rules = [("a.com", "/x", "block"), ("b.com", "/x", "allow"), ("com", "/", "allow")]
    index = DigestIndex(write_index(rules))
    assert index.judge(["a.com", "b.com", "c.com", "d.net"], ["/xy", "/x", "/", "/"]) == (["a.com/x", "b.com/x", "com/", None], ["block", "allow", "allow", "allow"])
