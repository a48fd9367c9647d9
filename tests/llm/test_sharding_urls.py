from collections import Counter

import pytest

from nichespark.llm import sharding, urlrules


def test_lookup_table_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(10))
    t = sharding.lookup_table(names, 1009)
    assert max(Counter(t).values()) - min(Counter(t).values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(t, less, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_slots_follow_turns():
    names = ("a", "b", "c")
    at = [sharding._number(f"offset:{n}") % 7 for n in names]
    skip = [sharding._number(f"skip:{n}") % 6 + 1 for n in names]
    want, nxt = [None] * 7, [0, 0, 0]
    while None in want:
        for i in range(3):
            while True:
                s = (at[i] + nxt[i] * skip[i]) % 7
                nxt[i] += 1
                if want[s] is None:
                    want[s] = i
                    break
            if None not in want:
                break
    assert list(sharding.lookup_table(names, 7)) == want


def test_assign(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (5, None)], "doc_id long, shard string")
    rows = sharding.assign_shards(df, ("a", "b"), size=13).collect()
    assert len(rows) == 4 and {r.shard for r in rows} <= {"a", "b"}
    assert len({r.slot for r in rows if r.doc_id == 1}) == 1
    assert sharding.assign_shards(df.limit(0), ("a", "b"), size=13).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://A.Example.NET/en/5?x#y"), (2, "http://example.net/fr/"), (3, "http://net"), (4, None), (5, "no scheme/net/"), (6, "x://de.example.com/de/1"),
        (7, "x://example.com/en"), (8, "x://wikipedia.org/fr/a"), (9, "x://notexample.net/en/1"), (10, "x://net?/en/"), (11, "x://" + "a." * 3000 + "net/" + "b" * 9000), (2, "http://example.net/fr/"), (12, ""), (13, "x:///en/"),
    ]
    rules = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, rule string")

    def brute(url):
        if url is None or "://" not in url:
            host = path = ""
        else:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fits = [(len(h + p), a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        return host, path, best[2], best[1]

    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlrules.filter_urls(df, rules).collect())
    assert got == sorted((i, b[0], b[1], b[2] or "", b[3]) for i, u in rows for b in [brute(u)])
    assert urlrules.filter_urls(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urlrules.filter_urls(df, []).collect()} == {"allow"}
