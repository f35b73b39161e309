import random
from datetime import datetime, timedelta

from kgloom.operators import orphans as O

T0 = datetime(2030, 1, 1)


def refs(spark, rows):
    return O.references(spark.createDataFrame([(n, a, b, at, "key", "kind") for n, a, b, at in rows], "link_no bigint, from_id string, to_id string, recorded_at timestamp, key string, kind string"), "links", "link_no", {"from_id": "pages", "to_id": "pages"})


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "id string, recorded_at timestamp, deleted_at timestamp, live int")


def brute(links, parents):
    can = lambda s: "_".join(x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split())
    index = {}
    for i, at, gone in parents:
        index.setdefault(can(i), []).append((at, gone))
    out = set()
    for n, a, b, at in links:
        for field, v in (("from_id", a), ("to_id", b)):
            if not v or not can(v):
                continue
            own = index.get(can(v))
            first = min((x for x, _ in own if x), default=None) if own else None
            kind = "missing" if not own else "deleted" if all(g for _, g in own) else "late" if first and at and first > at else None
            if kind:
                out.add((field, n, kind))
    return out


def test_epochs_agree_with_one_pass(spark):
    r = random.Random(3)
    day = lambda: T0 + timedelta(hours=r.randrange(2000))
    ids = [f"Page {i}" for i in range(40)]
    parents = [(x, day(), day() if r.random() < 0.3 else None) for x in ids[:30]] + [("page-3", day(), None), ("PAGE_4", day(), day())]
    links = [(n, r.choice([*ids, None, " ", "--"]), "page_0" if n % 3 else r.choice(ids).lower(), day() if r.random() < 0.95 else None) for n in range(300)]
    links += links[:20]
    want = brute(links, parents)
    for cuts in ([], [str(T0 + timedelta(hours=700)), str(T0 + timedelta(hours=1400))]):
        state = O.track(spark, [refs(spark, links)], [("pages", pages(spark, parents))], cuts)
        got = [(x.field_name, x.row_no, x.kind) for x in state.current().collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sum(x.refs for x in state.snapshot().collect()) == len(want)


def test_arrival_resolves_and_deletion_reopens(spark):
    state = O.OrphanState(spark)
    state.advance(refs(spark, [(1, "a", None, T0)]), None)
    assert [x.kind for x in state.current().collect()] == ["missing"]
    state.advance(None, O.parents(pages(spark, [("A", T0 - timedelta(1), None)]), "pages"))
    assert state.current().count() == 0
    state.advance(None, O.parents(pages(spark, [("A", T0 - timedelta(1), T0 + timedelta(9))]), "pages"))
    assert [(x.kind, x.ref_month) for x in state.current().collect()] == [("deleted", "2030-01")]


def test_empty_tables(spark):
    state = O.track(spark, [refs(spark, [])], [("pages", pages(spark, []))], [])
    assert state.current().count() == 0 and state.snapshot().count() == 0
    state = O.track(spark, [refs(spark, [(1, "x", "y", T0)])], [("pages", pages(spark, []))], [])
    assert {x.kind for x in state.current().collect()} == {"missing"}


def test_restart_repeat_and_failure(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    one = refs(spark, [(1, "a", "b", T0), (2, "c", None, T0)])
    O.OrphanState(spark, path).advance(one, None, batch=0)
    state = O.OrphanState(spark, path)  # a restart finds the state
    state.advance(one, None, batch=0)  # the batch that comes again changes nothing
    assert state.held["epoch"] == 1 and state.current().count() == 3
    arrived = O.parents(pages(spark, [("A", T0 - timedelta(1), None)]), "pages")
    broken = O.OrphanState(spark, path)
    monkeypatch.setattr(broken, "_commit", lambda held: 1 / 0)
    try:
        broken.advance(None, arrived, batch=1)
    except ZeroDivisionError:
        pass
    assert O.OrphanState(spark, path).current().count() == 3
    for _ in range(2):
        state = O.OrphanState(spark, path)
        state.advance(None, arrived, batch=1)
    assert {(r.field_name, r.row_no) for r in state.current().collect()} == {("to_id", 1), ("from_id", 2)}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    state = O.OrphanState(spark, str(tmp_path / "state"), buckets=8)
    state.advance(refs(spark, [(i, f"p{i}", "hot", T0) for i in range(60)]), None)
    before = dict(state.held["refs"])
    state.advance(None, O.parents(pages(spark, [("p7", T0 - timedelta(1), None)]), "pages"))
    after = state.held["refs"]
    assert sum(before[b] != after[b] for b in before) == 1
    for i in range(O.PARTS + 1):  # many small batches are compacted
        state.advance(refs(spark, [(100 + i, "hot", None, T0)]), None)
    assert max(map(len, state.held["refs"].values())) <= O.PARTS
    assert state.current().count() == 60 + 59 + O.PARTS + 1
