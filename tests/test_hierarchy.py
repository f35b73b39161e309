import random

from kgloom.operators import hierarchy as H

SCHEMA = "url string, parent_url string, depth bigint, fetched_at string, id int, key string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(u, p, d, t, 1, "x", "y") for u, p, d, t in rows], SCHEMA)


def brute(rows):
    """{url: (root or smallest cycle url, depth or -1)} for rows without repeats."""
    parent = {u: p if p in {x[0] for x in rows} else None for u, p, *_ in rows}
    out = {}
    for u in parent:
        seen, at = [], u
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        out[u] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at):]), -1)
    return out


def random_rows(n, seed, cyclic=True):
    r = random.Random(seed)
    urls = [f"https://h.example/{i}" for i in range(n)]
    return [(urls[i], r.choice([None, "", urls[r.randrange(n) if cyclic and r.random() < 0.1 else r.randrange(max(1, i))] if i else None, "https://h.example/never"]) if r.random() < 0.5 else (urls[i - 1] if i else None), r.randrange(4), "2030-01-01T00:00:00Z") for i in range(n)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(150, seed)
        want = brute(rows)
        nodes, members, endless = H.hierarchy(frame(spark, rows))
        url = {r.id: r.url for r in nodes.collect()}
        got = {url[r.id]: (url[r.root], r.real_depth) for r in members.collect()} | {url[r.id]: (r.cycle_url, -1) for r in endless.collect()}
        assert got == want
        found = {(r.url, r.root_url, r.real_depth) for r in H.wrong_depths(frame(spark, rows)).collect()}
        assert found == {(u, *want[u]) for u, _, d, _ in rows if want[u][1] == -1 or d != want[u][1]}


def test_paths_and_descendants(spark):
    rows = random_rows(120, 7, cyclic=False)
    want = brute(rows)
    parent = {u: p for u, p, *_ in rows}
    nodes, members, _ = H.hierarchy(frame(spark, rows))
    url = {r.id: r.url for r in nodes.collect()}
    m = {url[r.id]: r for r in members.collect()}
    paths = {url[r.id]: r.path for r in H.paths(nodes, members).collect()}

    def path(u):
        return [u] if want[u][1] == 0 else [*path(parent[u]), u]

    chain = {u: path(u) for u in m}
    assert paths == chain
    for u, r in m.items():
        below = {v for v, x in m.items() if x.root == r.root and r.pre <= x.pre < r.pre + r.size}
        assert below == {v for v, p in chain.items() if u in p}


def test_long_chain_and_ring(spark):
    n = 300
    chain = [(f"https://c.example/{i}", f"https://c.example/{i - 1}" if i else None, 0, "2030-01-01T00:00:00Z") for i in range(n)]
    ring = [(f"https://r.example/{i}", f"https://r.example/{(i + 1) % 7}", None, "2030-01-01T00:00:00Z") for i in range(7)]
    tail = [(f"https://t.example/{i}", "https://r.example/3" if i == 0 else f"https://t.example/{i - 1}", 2, None) for i in range(40)]
    found = {r.url: (r.root_url, r.real_depth) for r in H.wrong_depths(frame(spark, chain + ring + tail)).collect()}
    assert found == {f"https://c.example/{i}": ("https://c.example/0", i) for i in range(1, n)} | {u: ("https://r.example/0", -1) for u, *_ in ring + tail}


def test_spellings_latest_row_and_dirt(spark):
    rows = [
        ("https://a.example/x", None, 0, "2030-01-01T00:00:00Z"),
        ("https://a.example/y/", "HTTPS://A.example:443/x#top", 5, "2030-01-01T10:00:00+02:00"),
        ("https://a.example/y/", "https://a.example/gone", 3, "2030-01-01T09:00:00Z"),  # later as an instant
        ("https://a.example/y/", "https://a.example/gone", 3, "2030-01-01T09:00:00Z"),
        ("https://a.example/self", "https://a.example/self/", 1, "bad time"),
        (None, "https://a.example/x", 1, None),
        ("  ", None, 1, None),
    ]
    found = {(r.url, r.root_url, r.real_depth) for r in H.wrong_depths(frame(spark, rows)).collect()}
    assert found == {("https://a.example/y/", "https://a.example/y/", 0), ("https://a.example/self", "https://a.example/self", -1)}


def test_star_with_many_children_and_empty_table(spark):
    rows = [("https://s.example/", None, 0, None)] + [(f"https://s.example/{i}", "https://s.example", 1, None) for i in range(500)]
    nodes, members, _ = H.hierarchy(frame(spark, rows))
    got = members.collect()
    assert sorted(r.pre for r in got) == list(range(501)) and max(r.size for r in got) == 501
    assert H.wrong_depths(frame(spark, rows)).count() == 0
    assert H.wrong_depths(frame(spark, [])).count() == 0
