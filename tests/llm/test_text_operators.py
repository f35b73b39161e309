"""Text operators against brute force, round trips and dirty input."""

import os
import random
import re
import unicodedata

import numpy as np
import pytest

from kgloom.llm import boilerplate, leakage, neardup, scans, split, stuffing, tokens

LONG = "word " * 40_000


def docs(spark, texts, **extra):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, h string, grams string")


# ---------------------------------------------------------------- splitting


def check_pieces(text):
    out = split.split_text(text)
    assert "".join(text[b:c] for _, b, c in out) == text
    for k, (a, b, c) in enumerate(out):
        assert 0 < c - a <= split.LIMIT
        if k:
            assert b == out[k - 1][2] and split.OVERLAP_MIN <= b - a <= split.OVERLAP_MAX
    return out


def test_split_covers_any_text():
    r = random.Random(1)
    for _ in range(60):
        kind = r.choice(["ab c.\n\n", "x", "äöü. \n", "𝕏 y", "a-b\t"])
        check_pieces("".join(r.choice(kind) for _ in range(r.randrange(1, 9000))))
    assert split.split_text("") == [] and split.split_text("short") == [(0, 0, 5)]


def test_split_prefers_boundaries_and_word_starts():
    r = random.Random(2)
    text = "\n\n".join(" ".join("w" * r.randrange(2, 9) for _ in range(r.randrange(20, 60))) + "." for _ in range(40))
    for a, b, c in check_pieces(text)[:-1]:
        assert text[c - 2 : c] == "\n\n" and (a == 0 or text[a - 1].isspace())


def test_an_edit_changes_neighbours_only():
    r = random.Random(3)
    text = "\n\n".join(" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + str(r.randrange(999)) for _ in range(40)) + "." for _ in range(80))
    cuts = lambda t: [t[b:c] for _, b, c in split.split_text(t)]
    a, b = cuts(text), cuts("A new opening line.\n\n" + text)
    assert len(set(a) & set(b)) >= len(a) - 6


def test_split_frames(spark):
    chunk = "struct<id:string,type:string,markdown:string>"
    rows = [
        ("a", "m" * 3000, []), ("a", "m" * 3000, []), ("b", None, None), ("c", "x", [("1", "t", "s" * 10), (None, None, None), ("1", "t", "y " * 1500)]), ("d", "z" * 2000, None), ("e", "", None),
    ]
    df = spark.createDataFrame(rows, f"raw_path string, markdown string, chunks array<{chunk}>").selectExpr("*", "1 AS text", "2 AS piece")
    assert {tuple(r) for r in split.found(df).collect()} == {("a", 0, "oversized"), ("a", 0, "unbreakable"), ("c", 3, "oversized")}
    assert split.found(df.limit(0)).count() == 0
    whole = split.pieces(split.items(df), ["raw_path", "chunk_no"], oversized_only=False).where("raw_path = 'd'").collect()
    assert [(p.start, p.overlap, len(p.piece)) for p in whole] == [(0, 0, 2000)]


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def public():
    pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


ODD = ["", "a" * 5000, " " * 3001, "aaaa bbbb" * 500, "\x00\x01 <|endoftext|> x", "ééé👩‍👩‍👧" * 50, "don't I'll they'Ve", "التقرير يذكر", "日本語テキスト", "\n\n\t x\xa0y", "1234567 3.14", "ﬁne ½", LONG]


def test_ids_equal_the_public_tokenizer(public):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("ab é\n'1.") for _ in range(r.randrange(200))) for _ in range(200)]
    got = tokens._bpe(tokens.default_path()).encode(texts).to_pylist()
    assert got == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]
    assert [public.decode(g) for g in got[1:4]] == texts[1:4]


def test_long_words_equal_the_public_tokenizer(public):
    r = random.Random(9)
    letters = "etaoinshrdlucmfw"
    texts = ["".join(r.choice(x) for _ in range(n)) for x in (letters, "ab", "aaaaab", "thein", "äöüß", "0123456789", "=-") for n in (700, 3001, 9000)]
    texts += ["a" * 5000, "ab" * 4000, "abc" * 3000 + "x", "the" * 3000, "-" * 7001]
    got = tokens._bpe(tokens.default_path()).encode(texts).to_pylist()
    assert got == [e.ids for e in public.encode_batch(texts, add_special_tokens=False)]


def test_ids_frame(spark, public):
    df = docs(spark, [None, *ODD, "twice", "twice"])
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert len(got) == df.count() and got[0] == [] and got[1] == []
    assert got[2] == public.encode("a" * 5000).ids
    assert tokens.encode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- leakage


def words(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t or "") if unicodedata.category(c) != "Cf")
    return re.findall(r"[^\W_]+", t.lower())


def brute_leaks(texts, items, n=12):
    out = set()
    for i, t in items:
        w = words(t)
        runs = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        for d, text in enumerate(texts):
            v = words(text)
            if any(tuple(v[k : k + len(x)]) in runs for x in list(runs)[:1] for k in range(len(v) - len(x) + 1)):
                out.add((d, i))
    return out


def leak_case():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(120)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, make(r.choice([1, 2, 5, 11, 12, 13, 30, 60]))) for i in range(30)] + [(98, ""), (99, None), (100, make(20)), (101, None)]
    texts = [None, "", "?!"]
    for _ in range(150):
        base = make(r.randrange(5, 60))
        _, item = r.choice(items[:30])
        v = item.split()
        k = r.randrange(len(v))
        part = v[k : k + r.randrange(8, 20)] if len(v) > 12 else v
        joined = r.choice([" ", ", ", "\n", "­ ", "  "]).join(w.upper() if r.random() < 0.3 else w for w in part)
        texts.append(base + " " + joined + " " + make(5) if r.random() < 0.8 else base)
    texts += [texts[10], texts[10], "Ｆｕｌｌ " + (items[0][1] or ""), LONG + items[28][1]]
    return texts, items


def test_leaks_against_brute_force(spark):
    texts, items = leak_case()
    item_frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.found(docs(spark, texts), item_frame).collect()}
    assert got == brute_leaks(texts, items)
    assert leakage.found(docs(spark, texts).limit(0), item_frame).count() == 0
    assert leakage.found(docs(spark, texts), item_frame.limit(0)).count() == 0


def test_leaks_with_an_edit_and_in_blocks(spark, monkeypatch):
    item = "the harbour log at tirvane lists six thousand crates yet nobody counted them by lantern light"
    df = docs(spark, ["x " + item.replace("nobody", "nobocly") + " y", "unrelated text about other things entirely", item])
    items = spark.createDataFrame([(1, item), (2, "another item that is long enough to be of no use here at all today")], "item_id bigint, text string")
    want = {(0, 1, False), (2, 1, True)}
    assert {(r.doc_id, r.item_id, r.exact) for r in leakage.leaks(df, items).collect()} >= want
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 10)
    assert {(r.doc_id, r.item_id, r.exact) for r in leakage.leaks(df, items).collect()} >= want


# ---------------------------------------------------------------- near-duplicates


def near_case(n=120, seed=9):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bodies = []
    for _ in range(n):
        if bodies and r.random() < 0.6:
            w = r.choice(bodies).split()
            for _ in range(r.randrange(0, 6)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [w[k], r.choice(vocabulary)]])
            bodies.append(" ".join(w))
        else:
            bodies.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(18, 80))))
    rows = [(f"p{i}", b) for i, b in enumerate(bodies)] + [("n", None), ("e", ""), ("s", "too short"), ("p3", bodies[3])]
    return rows + [(f"copy{i}", bodies[0]) for i in range(5)]


def brute_pairs(rows, size, threshold, least):
    sets = {}
    for k, b in rows:
        w = re.findall(r"[^\W_]+", (b or "").lower())
        if len(w) >= least:
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    ks = sorted(sets)
    return {(a, b) for i, a in enumerate(ks) for b in ks[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_against_brute_force(spark):
    rows = near_case()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "id string, body string, h int, grams int")
    got = [(r.id_a, r.id_b) for r in neardup.pairs(df, "id", "body", size=3, threshold=0.7, least_words=20).collect()]
    want = brute_pairs(rows, 3, 0.7, 20)
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.98 * len(want)
    assert neardup.pairs(df.limit(0), "id", "body").count() == 0


def test_classes_of_any_size_list_all_pairs(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(f"c{i:02}", body) for i in range(65)] + [("z", body + " tail"), ("c00", body)]
    df = spark.createDataFrame(rows, "id string, body string")
    got = [tuple(r) for r in neardup.pairs(df, "id", "body").collect()]
    assert len(got) == len(set(got)) == 66 * 65 // 2 and all(a < b for a, b in got)


def test_all_pairs_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CLASS_PART", 20)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:02}", ("  ." * (i % 3)).join([" ".join(words[:20]), " ", " ".join(words[20:])])) for i in range(70)]
    rows += [("z", " ".join([*words, "more"])), ("y", " ".join(["less", *words]))]
    ids = sorted(x for x, _ in rows)
    df = spark.createDataFrame(rows, "id string, body string")
    got = [tuple(r) for r in neardup.pairs(df, "id", "body", size=3, threshold=0.7, least_words=20).collect()]
    assert sorted(got) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]


def test_recall_at_the_threshold_beside_a_crowd(spark):
    r = random.Random(5)
    crowd = [np.unique(np.r_[np.arange(400), 1000 + i]) for i in range(60)]  # found at any depth
    edge = []
    for i in range(1000):  # similarity 14 / 20
        s = np.array([r.getrandbits(62) for _ in range(20)])
        edge += [np.sort(s[:17]), np.sort(np.r_[s[:14], s[17:]])]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(crowd + edge)], "rid bigint, grams array<bigint>")
    got = {(x.a, x.b) for x in neardup.similar(df, 0.7).collect()}
    assert sum((60 + 2 * i, 61 + 2 * i) in got for i in range(1000)) >= 995
    assert neardup.prefix(0.7) == 6 and neardup.prefix(0.8) == 8 and 1 - (1 - 0.3 ** neardup.prefix(0.3)) ** neardup.TREES >= neardup.TARGET


def test_groups(spark):
    rows = near_case(80, 11)
    df = spark.createDataFrame(rows, "id string, body string")
    got = {r.id: r.group_id for r in neardup.groups(df, "id", "body", size=3, threshold=0.7, least_words=20).collect()}
    for a, b in brute_pairs(rows, 3, 0.7, 20):
        assert got[a] == got[b]
    assert all(got[g] == g for g in got.values()) and "n" not in got


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(501, 540)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.rid: x.root for x in neardup.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ---------------------------------------------------------------- stuffing


def test_covered_against_brute_force():
    r = random.Random(6)
    for _ in range(300):
        w = [r.choice(["a", "bb", "c"]) for _ in range(r.randrange(0, 14))]
        sizes = [len(x) for x in w]
        want, old = [False] * len(w), [False] * len(w)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                starts = [k for k in range(len(w) - j + i + 1) if w[k : k + j - i] == w[i:j]]
                if sum(sizes[i:j]) >= 3:
                    want[i:j] = [True] * (j - i) if len(starts) > 1 else want[i:j]
                    old[i:j] = [True] * (j - i) if starts[0] < i else old[i:j]
        anywhere, before = stuffing.repeats(w)
        assert stuffing.covered(anywhere, sizes, 3) == want
        assert stuffing.covered(before, sizes, 3) == old


PROSE = "The regional office in Varnhold named vendor lock-in as the main driver of the change. It was not expected to rise again before the end of the year. "
STUFF = ["cheap router best router price router\nbuy router free router deal\n" * 8, "- https://a.example/x/1\n- https://b.example/y/2\n" * 10, "SKU 12 | Quill router | steel | $60\nSKU 13 | Ferro lens | red | $48\n" * 6, "Torrin valve kepra gateway best deal. Orrel switch price torrin valve shipping! Best lattice blade deal torrin valve. " * 4, "[[a_b]] · [[c_d]]\n[[e_f]] · [[g_h]]\n" * 8]
CLEAN = [PROSE * 3, "# Title\n\n" + PROSE * 2 + "\n\nTags: a, b, c", "التقرير يذكر النتائج. Отчёт готов к печати.", "Selon la note, le comité de Drayholm a déplacé la production vers Sunderwick. " * 4, None, "", "   "]


def test_stuffed_pages(spark):
    df = docs(spark, [*STUFF, *CLEAN, LONG + PROSE])
    flags = {r.doc_id: r.stuffed for r in stuffing.pages(df).collect()}
    assert [flags[i] for i in range(len(STUFF))] == [True] * len(STUFF)
    assert [flags[len(STUFF) + i] for i in range(len(CLEAN))] == [False] * len(CLEAN)
    assert flags[len(STUFF) + len(CLEAN)] is True
    assert stuffing.found(df.limit(0)).count() == 0


def test_repetition_decides_with_the_clause_structure(monkeypatch):
    # full stops and a few short words do not make sentences of keywords; what tells them from terse prose is the repetition
    keys = "Nimbra drive top lattice drive cheap nimbra drive. New lattice drive buy nimbra drive sale lattice drive. Nimbra drive for lattice drive discount nimbra drive. " * 3
    terse = "Wexmoor Packaging recorded open claims on maintenance spending. Several customers postponed acceptance by one quarter. Regional suppliers expect to wait longer. "
    phrase = "deals on shoes for you and deals on shoes for the home. " * 40
    cyrillic = "Насос клапан цена. Клапан насос скидка. Цена насос клапан. Скидка клапан насос. " * 5
    judge = lambda x: stuffing.stuffed(*stuffing.profile(x))
    assert [judge(x) for x in (keys, phrase, cyrillic, terse)] == [True, True, True, False]
    monkeypatch.setattr(stuffing, "covered", lambda lengths, sizes, least=8: [False] * len(lengths))
    assert [judge(x) for x in (keys, phrase)] == [False, False]
    monkeypatch.setattr(stuffing, "covered", lambda lengths, sizes, least=8: [True] * len(lengths))
    assert judge(terse)


# ---------------------------------------------------------------- boilerplate

META = "map<string,string>"
PAGE = ["Home | About us | Contact", "We use cookies to keep the shop secure. You can withdraw consent.", "Accept all", "", "# Supply note", "", PROSE.strip(), "- revenue: $3 million", "| Period | revenue |", "|---|---|", "| Q1 | $3 million |", "Related articles", "Carbon ledger (3 min read)", "Price floor (4 min read)", PROSE.strip(), "Tags: one, two", "Back to top", "© 2030 Acme Works. All rights reserved."]


def site_pages():
    """Pages of other hosts that share the ways of sites, but not their words, with ``PAGE``."""
    r, out = random.Random(3), []
    names = ["Varnhold", "Norvale", "Ildria", "Lowmere", "Tirvane", "Brasmont"]
    for i in range(40):
        body = [f"The {r.choice(names)} office named {r.choice(names)} as the main driver of the change in {2000 + k} and expected it to rise again before the end of the year." for k in range(8)]
        page = [*PAGE[:4], f"# Item {i}", "", *body[:4], *PAGE[11:14], *body[4:], *PAGE[15:]]
        out.append((f"s{i}", "\n".join(page), {"extension": ".html", "url": f"https://h{i}.example/x", "title": f"Item {i}"}))
    return out


def test_article_of_one_page():
    assert boilerplate.article(None) == [] and boilerplate.article("Menu\nSearch") == [False, False] and boilerplate.article("") == []
    # the block decides: a text line alone is a body only if it is long enough, or another line of its block is
    line = "Eight words or a few more make up this line."
    assert boilerplate.article(line) == [False]
    assert boilerplate.article("\n".join([line] * 4)) == [True] * 4


def test_boilerplate_frames(spark, monkeypatch):
    meta = {"extension": ".html", "url": "https://h.example/x", "title": "Supply note"}
    rows = [("a", "\n".join(PAGE), meta), ("a", "\n".join(PAGE), meta), ("b", None, meta), ("c", "", meta), ("d", "x", {"extension": ".pdf"}), ("e", "y", None), ("f", LONG, {"extension": ".html"})]
    df = spark.createDataFrame([(*r, 1, 2) for r in [*rows, *site_pages()]], f"raw_path string, markdown string, metadata {META}, lines int, keep int")
    got = sorted((r.raw_path, r.line_no) for r in boilerplate.found(df).collect())
    assert [n for p, n in got if p == "a"] == [1, 2, 3, 12, 13, 14, 16, 17, 18]
    text = {r.raw_path: r.text for r in boilerplate.main_text(df).collect()}
    assert set(text) == {"a", "b", "c", "f"} | {f"s{i}" for i in range(40)} and text["a"].startswith("# Supply note") and text["b"] in (None, "")
    assert boilerplate.found(df.limit(0)).count() == 0
    # without the densities that the corpus teaches, the notice is taken for text
    monkeypatch.setattr(boilerplate, "model", lambda counts: ({}, {}))
    assert 2 not in {r.line_no for r in boilerplate.found(df).where("raw_path = 'a'").collect()}


def test_surge_and_dive_decide(monkeypatch):
    page = "A short line of six words.\n\nPick | Choose\nPick | Leave\nTake | Leave\n\n" + PROSE
    assert boilerplate.article(page) == [False] * 6 + [True]
    monkeypatch.setattr(boilerplate, "SURGE", 1)
    assert boilerplate.article(page)[0]


def test_lines_that_recur_on_a_host(spark):
    rows = [(f"p{i}", f"Unfamiliar slogan\n\n{PROSE}{i}.\n\nOdd footer words", {"extension": ".html", "url": "https://h.example/x"}) for i in range(6)]
    df = spark.createDataFrame(rows, f"raw_path string, markdown string, metadata {META}")
    assert {r.line_no for r in boilerplate.found(df).collect()} == {1, 5}


# ---------------------------------------------------------------- scans


def scan_rows():
    sentence = "the division confirmed that the quarterly revenue would recover because several customers accepted the warranty framework"
    pages, meta = [], {"extension": ".pdf"}
    for d in range(40):
        body = []
        for p in range(3):
            if p:
                body += ["", "---", "", "Acme Grid | Confidential"]
            else:
                body += ["Acme Grid Report", ""]
            body += [sentence, f"{sentence} {'again' if p else 'now'}", f"[{p + 1}]"]
        pages.append((f"d{d}", "\n".join(body), None, meta))
    noisy = ["Acme Grid Report", "", "the divisi0n confirmed that the quar-", "terly reveriue would recover because", "several customers accepted like-for-", "like the warranty", "[1]", "", "---", "", "Acme Grid | Confidential", "framework", "[2]"]
    return [*pages, ("noisy", "\n".join(noisy), None, meta), ("noisy", "\n".join(noisy), None, meta), ("none", None, None, meta), ("blank", "", None, meta), ("other", "x", None, None), ("long", LONG, None, meta)]


SCAN = f"raw_path string, markdown string, chunks array<struct<id:string,markdown:string>>, metadata {META}"


def test_scan_findings(spark):
    hyphened = [("h%d" % i, "a like-for-like basis with a like-for-like view", None, {"extension": ".pdf"}) for i in range(6)]
    df = spark.createDataFrame(scan_rows() + hyphened, SCAN).selectExpr("*", "1 AS w", "2 AS line")
    got = {(r.line_no, r.kind) for r in scans.found(df).where("raw_path = 'noisy'").collect()}
    assert got == {(3, "misread"), (3, "hyphen"), (4, "misread"), (7, "furniture"), (11, "furniture"), (13, "furniture")}
    text = {r.raw_path: r.text for r in scans.repaired(df).collect()}
    assert text["noisy"] == "Acme Grid Report\n\nthe division confirmed that the quarterly revenue would recover because several customers accepted like-for-like the warranty framework"
    assert text["blank"] == "" and "none" not in text
    assert scans.found(df.limit(0)).count() == 0


def test_context_decides_on_rare_words(spark, monkeypatch):
    # "dean" is a stroke twin of "clean", eight times as frequent, with other words around it
    meta = {"extension": ".pdf"}
    rows = [(f"a{i}", "they keep the water clean for every village there", None, meta) for i in range(160)]
    rows += [(f"b{i}", "our faculty elected a dean of science last spring", None, meta) for i in range(12)]
    rows += [("one", "they keep the water dean for every village there\nour faculty elected a dean of science last spring", None, meta)]
    df = spark.createDataFrame(rows, SCAN)
    assert {tuple(r) for r in scans.found(df).collect()} == {("one", 1, "misread")}
    text = {r.raw_path: r.text for r in scans.repaired(df).collect()}
    assert text["one"] == "they keep the water clean for every village there our faculty elected a dean of science last spring"
    assert text["b0"] == rows[160][1]
    # without the vectors every "dean" would be taken for "clean"
    learned = scans.vectors
    monkeypatch.setattr(scans, "vectors", lambda *a: tuple(np.zeros_like(x) for x in learned(*a)))
    assert scans.found(df).count() == 14


def test_two_places_in_one_line_are_told_apart(spark):
    meta = {"extension": ".pdf"}
    rows = [(f"a{i}", "they keep the water clean for every village there", None, meta) for i in range(160)]
    rows += [(f"b{i}", "our faculty elected a dean of science last spring", None, meta) for i in range(12)]
    line = "our faculty elected a dean of science last spring they keep the water dean for every village there"
    df = spark.createDataFrame([*rows, ("one", line, None, meta), ("one", line, None, meta)], SCAN)
    notes = scans.findings(df).where("raw_path = 'one'").collect()
    assert [(x.line_no, x.kind, x.w, x.f) for x in notes] == [(1, "misread", "dean", "clean")]


def test_heads_where_pages_cannot_be_told_apart():
    text = ["Yearly Report", "", "the first part of the text goes on and", "on", "", "Acme Grid | Any Words", "and ends here.", "A | table | row", "", "| a | b |", "| c | d |", "", "Acme Grid", "Part 3 · Copy 2", "more text here."]
    assert [i for i, k in enumerate(scans.furniture(text, None)) if k == "furniture"] == [5, 12, 13]


def test_glyph_edits():
    assert scans.edits("iricome", "income") == [1] and scans.edits("raisecl", "raised") == [5]
    assert scans.edits("ﬁscal", "fiscal") == [0] and scans.edits("filmgs", "filings") is not None
    assert scans.edits("word", "word") is None and scans.edits("house", "mouse") is None


def test_vectors_bring_words_of_like_contexts_together(spark):
    rows = [(f"v{i}", f"the {a} was sold in {b} by the firm", None, {"extension": ".pdf"}) for i, (a, b) in enumerate([(x, y) for x in ("pump", "valve") for y in ("spring", "autumn")] * 20)]
    names = ["the", "pump", "valve", "was", "sold", "in", "spring", "autumn", "by", "firm"]
    u, v = scans.vectors(scans.parsed(scans.pdf(spark.createDataFrame(rows, SCAN))), names)
    cosine = lambda a, b: float(u[names.index(a)] @ u[names.index(b)] / ((u[names.index(a)] ** 2).sum() * (u[names.index(b)] ** 2).sum()) ** 0.5)
    assert cosine("pump", "valve") > cosine("pump", "spring") and cosine("spring", "autumn") > cosine("spring", "was")
