from corpusloom.llm import url_filters as u

SCHEMA = "page_id long, url string, html string, host string"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def rule(host, path):
    best = None
    for kind, h, p in u.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (kind, h + p)
    return best


URLS = [
    "http://a.example.net/en/1", "http://a.example.net/de/1", "https://EXAMPLE.com/de/x?y#z", "http://notexample.com/de/", "http://x.org/fr/a", "http://x.org/fr", "http://net", "http://net/",
    "http://q.net?x=/y", "ftp://h.Ä.ORG#/fr/", "nothing", "", None, "://", "a://b://c/d", "http://u@h.net:80/p", "http://x.org\n/fr/", "http://example.com/de/",
]


def test_rules_against_brute(spark):
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(URLS)] + [(0, URLS[0], None, "x")], SCHEMA)
    for r in u.report(df).collect():
        host, path = host_path(URLS[r.page_id])
        want = rule(host, path)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (want[1] if want else None)
        if want:
            assert r.verdict == want[0]
    assert u.report(df).count() == len(URLS) + 1
    assert u.report(df.limit(0)).count() == 0


def test_reputation_shrinks(spark):
    """A host with many bad pages is blocked; one bad page alone is not enough."""
    bad, good = "<p>" + "#$% " * 30, "<p>plain words here"
    rows = [(i, f"http://bad.example.com/x{i}", bad, "x") for i in range(60)] + [(100 + i, f"http://good{i % 9}.example.com/", good, "x") for i in range(300)]
    rows += [(900, "http://once.example.com/", bad, "x"), (901, "http://www.spam.co.uk/", good, "x")]
    got = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].verdict == "block"
    assert got[900].verdict == "allow" and got[900].bad_rate > got[100].bad_rate
    assert got[100].verdict == "allow"


def test_suffixes(spark):
    from pyspark.sql import functions as F

    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.example.com": ("com", "example.com"), "net": ("net", "net"), "": ("", ""), "co.uk": ("co.uk", "co.uk"), "b.de": ("de", "b.de")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    s, d = u.suffix_and_domain(F.col("h"))
    assert {r.h: (r.s, r.d) for r in df.select("h", s.alias("s"), d.alias("d")).collect()} == hosts


def test_reputations_against_brute(spark):
    """Strengths by moments at each level, posterior means and bounds."""
    import random

    import pytest

    rng = random.Random(7)
    hosts = {f"h{i}.d{i % 12}.{('com', 'org', 'de')[i % 3]}": (rng.randint(0, 30), rng.choice([0.05, 0.1, 0.9])) for i in range(60)}
    rows = [(h, int(rng.random() < p)) for h, (n, p) in hosts.items() for _ in range(n)] + [(h, None) for h in hosts]
    got = {r.host: (r.bad_rate, r.bad_low) for r in u.reputations(spark.createDataFrame(rows, "host string, outcome int")).collect()}
    own = {h: (sum(a == h and b is not None for a, b in rows), sum(b or 0 for a, b in rows if a == h)) for h in hosts}

    def summed(of, parts):
        out = {}
        for x, (n, k) in parts.items():
            a, b = out.get(of(x), (0, 0))
            out[of(x)] = (a + n, b + k)
        return out

    def up(x):
        return x.split(".", 1)[1]

    domains = summed(up, own)
    suffixes = summed(up, domains)
    n, k = (sum(x) for x in zip(*suffixes.values(), strict=True))

    def fitted(level, mean):
        over = sum((k - n * mean(x)) ** 2 - n * mean(x) * (1 - mean(x)) for x, (n, k) in level.items())
        base = sum(n * mean(x) * (1 - mean(x)) * (n - 1) for x, (n, k) in level.items())
        m = 1000.0 if over <= 0 or base <= 0 else min(1000.0, max(1.0, base / over - 1))
        return m, {x: (k + m * mean(x)) / (n + m) for x, (n, k) in level.items()}

    _, s = fitted(suffixes, lambda x: (k + 0.5) / (n + 1))
    _, d = fitted(domains, lambda x: s[up(x)])
    m, h = fitted(own, lambda x: d[up(x)])
    for x, (n_x, k_x) in own.items():
        a, b = k_x + m * d[up(x)], n_x - k_x + m * (1 - d[up(x)])
        low = a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
        assert got[x] == pytest.approx((h[x], low))
