"""Host, path, rules and link trust against plain Python."""

import random
import re
from collections import Counter, defaultdict

from gearsight.llm import url_filter as U

PAGES = "page_id long, url string, html string, host int, mass string, n long, bad int"


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2, 3) for i, u, h in rows], PAGES)


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_mass(seeds, edges):
    rank, out = dict(seeds), Counter()
    for (a, _), n in edges.items():
        out[a] += n
    for _ in range(U.ITERATIONS):
        new = defaultdict(float)
        for h, m in rank.items():
            if out[h]:
                for (a, b), n in edges.items():
                    if a == h:
                        new[b] += U.DAMPING * m * n / out[h]
            else:
                new[h] += U.DAMPING * m
        for h, m in seeds.items():
            new[h] += (1 - U.DAMPING) * m
        rank = dict(new)
    return rank


def test_parts_and_rules(spark):
    urls = ["http://A.Example.net/en/x?q#f", "https://example.com/de/", "x.org/fr/", None, "", "://", "ftp://b.org/fr/1",
            "http://org/fr/", "http://notorg/fr/", "http://net", "http://net/", "http://x.net?a=/en/", "a://b://c.net/z",
            "http://example.comx/de/", "HTTP://WWW.EXAMPLE.COM/de/a", "http://u.example.net/en", "http://é.org/fr/é",
            "http://h.org#/fr/"]
    got = {r.page_id: r for r in U.judge(pages_frame(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()}
    for i, u in enumerate(urls):
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if verdict:
            assert got[i].verdict == verdict


def test_trust_flow(spark):
    rng = random.Random(8)
    hosts = [f"h{i}.{t}" for i in range(8) for t in ("org", "net", "com", "example.com")]
    rows = []
    for i in range(220):
        h = rng.choice(hosts)
        path = rng.choice(["/en/", "/fr/", "/de/", "/"])
        links = "".join(f'<a class="x" HREF={q}{rng.choice(["http://", "https://", "//"])}{rng.choice(hosts).upper()}/p{q}>'
                        for q in ['"', "'"] for _ in range(rng.randint(0, 2)))
        rows.append((i, f"http://{h}{path}{i}", rng.choice([None, ""]) if i % 9 == 0 else f"<p>{links}<a href='/own'>"))
    bad = "".join(f'<a href="http://h{i}.net/p">' * 5 for i in range(8))
    rows += [(300, "http://few.org/en/1", bad), (301, "http://far.com/1", '<a href="//few.org/">' * 9), rows[5]]
    got = U.judge(pages_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    allowed, blocked, undecided, edges = Counter(), Counter(), Counter(), Counter()
    for _, u, html in rows:
        host, path = plain_parts(u)
        verdict = plain_rule(host, path)[1]
        (allowed if verdict == "allow" else blocked if verdict == "block" else undecided)[host] += 1
        for x in re.findall(r"(?i)href=[\"'](?:https?:)?//([^/\"']+)", html or ""):
            if x.lower() != host:
                edges[(host, x.lower())] += 1
    trust = plain_mass(allowed, edges)
    doubt = plain_mass(blocked, {(b, a): n for (a, b), n in edges.items()})
    seen = set()
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-9 and abs(r.distrust - doubt.get(r.host, 0)) < 1e-9
        if r.rule is None:
            bad = doubt.get(r.host, 0)
            want = "block" if bad > 0 and bad >= .5 * (bad + trust.get(r.host, 0) + undecided[r.host]) else "allow"
            assert r.verdict == want
            seen.add(want)
    assert seen == {"allow", "block"}


def test_empty(spark):
    assert U.judge(pages_frame(spark, [])).collect() == []
