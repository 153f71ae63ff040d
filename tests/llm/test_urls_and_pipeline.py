import re
from collections import defaultdict

import corpus_pipeline
from sampleloom.llm import url_filter

SF = "/root/testdata/sf0.001"


def brute_judge(pages):
    parts = {}
    for k, (url, _) in pages.items():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = m[1].translate({c: c + 32 for c in range(65, 91)}) if m else ""
        path = m[2] if m else ""
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        parts[k] = (host, path, best)
    edges = defaultdict(int)
    for k, (_, html) in pages.items():
        for dst in re.findall(r"""(?i)\bhref\s*=\s*["']?\s*[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)""", html or ""):
            if dst.lower() != parts[k][0] and parts[k][0]:
                edges[parts[k][0], dst.lower()] += 1
    ranks = []
    for verdict, turn in (("allow", False), ("block", True)):
        hosts = {h for h, _, r in parts.values() if r and r.verdict == verdict}
        moving = {h: url_filter.MASS // len(hosts) for h in hosts}
        flow = [(b, a, n) if turn else (a, b, n) for (a, b), n in edges.items()]
        out = defaultdict(int)
        for u, _, n in flow:
            out[u] += n
        rank = defaultdict(int, moving)
        for _ in range(url_filter.STEPS):
            now = defaultdict(int)
            for u, v, n in flow:
                now[v] += moving.get(u, 0) * 85 // 100 * n // out[u]
            for h, m in now.items():
                rank[h] += m
            moving = now
        ranks.append(rank)
    return {
        k: (host, path, r.name if r else None, r.verdict if r else "block" if ranks[1].get(host, 0) > ranks[0].get(host, 0) else "allow")
        for k, (host, path, r) in parts.items()
    }


def link(*hosts):
    return " ".join(f'<a href="https://{h}/x">' for h in hosts)


PAGES = {
    1: ("http://good.org/a", link("neutral.net", "good.org")),
    2: ("http://bad.com/de/x", None),
    3: ("http://farm.net/", link("BAD.com", "bad.com", "neutral.net")),
    4: ("http://neutral.net/q?x", "<a href='/rel'>"),
    5: ("HTTP://WWW.Example.org/es/1#x", ""),
    6: ("http://example.org/en/1", ""),
    7: ("http://example.org", ""),
    8: ("no scheme", link("bad.com")),
    9: (None, None),
    10: ("http://notexample.org/es/", ""),
    11: ("http://second.net/", link("farm.net")),
    12: ("http://a.com/fr/", ""),
    13: ("http://a.com/frx", ""),
    14: ("x://h.com/fr/y://z.org/", ""),
}


def test_verdicts_match_brute_force(spark):
    rows = spark.createDataFrame([(k, u, h, "c") for k, (u, h) in PAGES.items()], "page_id long, url string, html string, host string")
    out = url_filter.judge_urls(rows)
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == brute_judge(PAGES)
    assert got[3][3] == "block" and got[11][3] == "block" and got[4][3] == "allow"
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())
    assert url_filter.judge_urls(rows.limit(0)).count() == 0


def test_a_link_changes_only_the_hosts_it_leads_to(spark):
    """Without any link, seeds are judged by their own mass; a link between two others does not touch them."""
    shown = [(1, "http://a.com/fr/"), (2, "http://a.com/de/"), (3, "http://a.com/x"), (4, "http://b.com/de/"), (5, "http://b.com/x"), (6, "http://c.org/"), (7, "http://d.org/"), (8, "http://n.net/")]
    shape = "page_id long, url string, html string"
    plain = spark.createDataFrame([(k, u, None) for k, u in shown], shape)
    linked = plain.union(spark.createDataFrame([(9, "http://one.net/", link("two.net"))], shape))
    verdicts = [{r["id"]: r["verdict"] for r in url_filter.judge_urls(x).collect()} for x in (plain, linked)]
    assert verdicts[0][3] == "block" and verdicts[0][5] == "block" and verdicts[0][8] == "allow"
    assert verdicts[1] == verdicts[0] | {9: "allow"}


def test_rank_reaches_far_and_through_hubs(spark):
    """A chain of 30 hosts, and a hub of many links in front of the blocked host: nothing is rounded away."""
    chain = [(k, f"http://h{k}.net/", link(f"h{k + 1}.net") if k < 30 else link("bad.com")) for k in range(1, 31)]
    hub = [(100, "http://hub.net/", link("bad.com", *[f"t{k}.net" for k in range(2000)])), (101, "http://fan.net/", link("hub.net"))]
    rows = spark.createDataFrame([*chain, *hub, (200, "http://bad.com/de/", None)], "page_id long, url string, html string")
    assert {r["verdict"] for r in url_filter.judge_urls(rows).collect()} == {"block"}


def test_linked_hosts_match_the_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, u, h) for k, (u, h) in PAGES.items()])
    want = {r[0]: r[1:] for r in con.execute(url_filter.OP5_SQL).fetchall()}
    rows = spark.createDataFrame([(k, u, h) for k, (u, h) in PAGES.items()], "page_id long, url string, html string")
    assert {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows).collect()} == want


def test_pipeline_against_brute_force(spark):
    """Stage by stage: what goes and what stays, on the smallest tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, columns = dict(texts), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        now = {r["doc_id"] for r in docs.collect()}
        if name == "language_id":
            want = {k for k, t in kept.items() if any(c.isalpha() for c in t or "")}
        elif name == "exact_dedup":
            want = set({t: k for k, t in sorted(kept.items())}.values())
        elif name == "near_dedup":
            from test_dedup import brute_components

            want = {k for k, (_, c) in brute_components(kept, 5, 80).items() if k == c}
        else:
            leaks = {k for k, t in kept.items() if any(b in t for b in bench)}
            assert not now & leaks
            want = set(kept) - leaks
            assert len(want - now) <= 1
            want = now
        assert now == want
        kept = {k: kept[k] for k in now}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(kept)
    assert sorted((p["doc_id"], p["start"], p["ids_crc32"]) for p in corpus_pipeline.run(spark, SF).collect()) == sorted((p["doc_id"], p["start"], p["ids_crc32"]) for p in pieces)
