"""Edge cases of each operator: nulls, empty and long texts, ties, repeats, odd columns, no rows."""

import os
import sys
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from geohour.llm import (  # noqa: E402
    decontaminate, extract, grades, licenses, markup, middle, order_minhash, packing, quality_rules, simhash, spelling,
    suffixes, urls, warc,
)
from geohour.llm.common import connected_components, free_name, prepare  # noqa: E402

RNG = np.random.default_rng(5)


def prose(n, seed=None):
    rng = RNG if seed is None else np.random.default_rng(seed)
    return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


PASSAGE = prose(60, 1)
LONG = prose(20_000, 2)
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, fp string, __id int, spans string, "
          "term string, rules int, n_words int, queue int")


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    texts = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "a"), (5, LONG, "hot"), (6, LONG, "hot"),
        (7, PASSAGE + " " + prose(30, 3), "hot"), (8, prose(40, 4) + " " + PASSAGE, "b"), (8, prose(40, 4) + " " + PASSAGE, "b"),
        (9, "Ünï cödé ÀÉ   double  blanks\n\n\tand <|endoftext|> tabs\u00a0x", "b"), (10, "the same line\n" * 40, ""),
        (None, prose(20, 6), None), (None, None, None), (11, "x" * 1000, "hot"), (12, "Word " * 400, "hot"),
    ]
    rows = [(d, t, None, s, None, "z", 7, "z", "z", 1, 2, 3) for d, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [("i1", " ".join(PASSAGE.split()[5:30])), ("i2", "ONE"), (None, prose(12, 3)), ("i3", None), ("i4", "..."),
         ("i1", "other words"), ("i5", " ".join(PASSAGE.split()[5:30]))], "item_id string, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_packing_edges(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    numbered = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [0] for r in numbered.collect()}
    rows = packing.pack(numbered).collect()
    brute.check_packing(rows, ids)
    both = packing.pack(docs).collect()
    assert sum(r.length for r in both) > sum(r.length for r in rows)
    assert packing.pack(none).collect() == []


def test_packing_meets_targets(spark):
    prepare(spark)
    rows = [(i, prose(50, i), "big" if i % 3 else "small") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for targets, share in ((None, None), ({"big": 1.0, "small": 1.0}, 0.5)):
        got = packing.pack(df, sequence=64, window_sequences=4, targets=targets).collect()
        tokens = Counter()
        for r in got:
            tokens[r.window, r.source] += r.length
        total = Counter(s for _, _, s in rows)
        share = share or sum(r.length for r in got if r.source == "small") / sum(r.length for r in got)
        first = [w for w in range(5)]
        for w in first:
            size = tokens[w, "big"] + tokens[w, "small"]
            assert abs(size - 256) <= 2 and abs(tokens[w, "small"] - share * size) <= 2
        assert total["big"] == 200
        full = Counter()
        for r in got:
            full[r.sequence_id] += r.length
        assert all(n == 64 for s, n in full.items() if s != max(full))


def test_packing_keeps_a_queue_per_source(spark, monkeypatch):
    prepare(spark)
    rows = [(i, prose(30, i), "big" if i % 2 else f"s{i % 60}") for i in range(240)] + [(240, prose(30, 240), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).cache()

    def packed(targets):
        return sorted(packing.pack(df, sequence=64, window_sequences=8, targets=targets).collect())

    for targets in (None, {"big": 1.0, "s2": 0.25, "none": 3.0}):
        dense = packed(targets)
        with monkeypatch.context() as m:
            m.setattr(packing, "DENSE_QUEUES", 2)
            m.setattr(packing, "WINDOW_BLOCK", 7)
            got = packed(targets)
        assert got == dense and {r.source for r in got} == {s or "" for _, _, s in rows}
        at = sorted((r.sequence_id, r.offset, r.length) for r in got)
        assert all((b[0], b[1]) == ((a[0], a[1] + a[2]) if a[1] + a[2] < 64 else (a[0] + 1, 0)) for a, b in zip(at, at[1:]))


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa

    enc = packing.encoder(packing.VOCABULARY)
    texts = [prose(300, i).replace("a ", "a. ").replace("b ", "b,\n") for i in range(20)]
    texts += ["", " ", "a  b", "it's we'll 12.5%", "<|endoftext|>", "x\u2003y", "é\n", "\nq", "a\0b", "ß ünd\nÀ"]
    for t, got in zip(texts, enc.encode(pa.array(texts))):
        assert got.tolist() == enc.whole.encode(t, add_special_tokens=False).ids


def test_licence_edges(spark, docs, none):
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0
    filler, apache = prose(300, 8), dict(licenses.TEMPLATES)["apache-2.0-header"]
    near = apache.replace("License at", "thing at")
    df = spark.createDataFrame([(1, f"{filler} {apache} {filler}"), (1, f"{filler} {apache} {filler}"), (2, near), (3, apache[:40]),
                                (None, apache)], "doc_id long, text string")
    got = {(r.doc_id, r.template): r for r in licenses.scan(df).collect()}
    assert got[1, "apache-2.0-header"].containment == 1 and got[None, "apache-2.0-header"].containment == 1
    assert 0.8 <= got[2, "apache-2.0-header"].containment < 1
    assert (3, "apache-2.0-header") not in got
    assert licenses.MISS < 1e-3


def test_many_licence_templates(spark, monkeypatch):
    prepare(spark)
    templates = [(f"t{i}", prose(20 + i, 500 + i)) for i in range(300)]
    cut = templates[7][1].split()
    texts = [(i, f"{prose(50, 900 + i)} {templates[i][1]} {prose(70, 950 + i)} {templates[(i * 7) % 300][1]}", "x") for i in range(0, 300, 11)]
    texts += [(1000, " ".join(cut[:-2]), "x"), (1001, " ".join(cut[:len(cut) // 2]), "x"), (None, templates[9][1], "x"), (None, None, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string, own string")
    table = spark.createDataFrame(templates + [("t3", templates[3][1]), ("none", None)], "template string, text string")
    want = {(d, f"t{k}") for d, _, _ in texts[:-4] for k in (d, d * 7 % 300)} | {(1000, "t7"), (None, "t9")}
    plain = licenses.scan(df, table).collect()
    assert {(r.doc_id, r.template) for r in plain} == want
    assert all(r.containment == 1 for r in plain if r.doc_id != 1000)
    monkeypatch.setattr(licenses, "small", lambda d: d)  # as with tables too large to broadcast
    assert sorted(map(str, licenses.scan(df, table).collect())) == sorted(map(str, plain))


def test_full_licence_texts_are_told_apart(spark):
    texts = dict(licenses.TEMPLATES)
    df = spark.createDataFrame([(k, f"{prose(80, i)} {v} {prose(90, i + 50)}") for i, (k, v) in enumerate(texts.items())], "doc_id string, text string")
    found = {(r.doc_id, r.template) for r in licenses.scan(df).collect() if r.containment == 1}
    assert {(k, k) for k in texts} <= found
    assert ("mit-text", "mit-grant") in found and ("mit-grant", "mit-text") not in found
    assert ("bsd-2-clause", "bsd-3-clause") not in found


def test_decontamination_edges(docs, none, items):
    texts = docs.select("doc_id", "text").collect()
    known = {r.item_id: r.text for r in items.collect() if r.item_id not in ("i1", None)}
    rows = decontaminate.contamination(docs, items).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    assert got[1].n_words == 0 and not got[1].contaminated
    assert got[4].n_hit == 1 and got[4].n_items == 1
    assert got[7].n_hit == 37 and got[7].n_items == 2  # a passage of 25 words and an item without id
    assert sum(r.doc_id == 8 for r in rows) == 2 and got[8].n_hit == 25
    for d in (8, 5):
        text = next(r.text for r in texts if r.doc_id == d)
        assert brute.contaminated_words(text, known)[1] == got[d].n_hit
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 5, 6, 9, 10, 11, 12, None}


def test_proximity_matches(spark):
    prepare(spark)
    w = prose(12, 9).split()
    docs = spark.createDataFrame(
        [(1, " ".join(w)), (2, " ".join(w[:4] + ["extra"] + w[4:])), (3, prose(30, 10))], "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(w))], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.matches(docs, items).collect()} == {1}
    near = decontaminate.matches(docs, items, slop=2).collect()
    assert {r.doc_id for r in near} == {1, 2}
    assert all(r.doc_id == 1 for r in near if r.exact) and any(not r.exact for r in near)


def test_extraction_edges(spark):
    page = ("<html><head><title>T</title></head><body><nav><a href='/'>Menu</a></nav><article><h1>Head &amp; line</h1>"
            "<p>First   text&nbsp;here.<br>More<p>Second.<div class='ad'>Buy</div></article>"
            "<div class='comments'><p>I disagree.</p></div><footer>Foot</footer>")
    schema = "page_id long, url string, html string, text int, n_chars int"
    df = spark.createDataFrame([(1, "u", page, 1, 1), (1, "u", page, 1, 1), (2, None, None, 1, 1), (3, "u", "", 1, 1),
                                (None, "u", "just text", 1, 1), (4, "u", "<article>" + "<p>a b.</p>" * 3000, 1, 1)], schema)
    labeller = extract.fit(df)
    got = extract.extract(df, labeller).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6
    assert by[1].text == "Head & line\nFirst text here. More\nSecond."
    assert by[2].text == "" and by[3].n_chars == 0
    assert by[4].text.count("\n") == 2999
    assert extract.extract(df.limit(0), labeller).count() == 0
    assert extract.fit(df.limit(0), made=4).out.any()


def test_labeller_on_pages_it_has_not_seen():
    rng = np.random.default_rng(99)
    made, y = zip(*[extract.labelled(extract.made_page(rng)) for _ in range(500)])
    m = extract.train(extract.new_labeller(), [extract.vectors(p) for p in made[:400]], y[:400])
    p = m.probabilities([extract.vectors(b) for b in made[400:]])
    assert np.mean(np.concatenate([(a >= 0.5) == b for a, b in zip(p, y[400:])])) > 0.97


PLAIN_PAGES = (
    ("""<html><body><div id=top><a href=/>Home</a> <a href=/news>News</a> <a href=/sport>Sport</a></div>
     <table><tr><td><h1>#Bridge closed for repairs</h1><p>#The old stone bridge will stay closed until spring, the council said
     on Monday. Engineers found cracks in two of its arches.</p><p>#Drivers must use the ring road, which adds about ten
     minutes to the way into town. Buses run as before.</p><p>#Shops on the far bank fear for their trade.</p></td></tr></table>
     <div><h3>Most read</h3><ul><li><a href=/1>Storm ahead</a><li><a href=/2>New school opens</a><li><a href=/3>Cup final</a></ul></div>
     <div>Copyright 2021 Valley Press</div></body></html>"""),
    ("""<body><ul><li><a href="/a">Recipes</a></li><li><a href="/b">Drinks</a></li><li><a href="/c">Shop</a></li></ul>
     <div class="col-8 x1"><h2>#Bread without kneading</h2><div>#Stir flour, salt, yeast and water in a bowl until no dry flour is
     left. Cover it and let it stand overnight.</div><div>#In the morning the dough has doubled. Fold it twice, put it on a floured
     board and wait for an hour.</div><div>#Bake it in a hot pot for forty minutes. Let it cool before you cut it.</div></div>
     <div class="col-4"><h4>More</h4><div><a href="/p1">Rye bread</a></div><div><a href="/p2">Flat bread</a></div></div>
     <div><form>Your mail <input name=m><button>Send</button></form></div><p>&copy; 2019 Kitchen</p></body>"""),
    ("""<html><body><span><a href="/">Log</a></span><section><h1>#Three weeks on foot</h1><p>#We set out from the coast in rain, with more
     in our bags than we could carry. After two days we sent half of it home.<p>#The hills came sooner than the map had promised. On
     the fourth evening we slept in a barn, and the farmer woke us with coffee.<p>#What I remember best is the quiet.</section>
     <div><a href="/x">Older</a> | <a href="/y">Newer</a> | <a href="/z">Archive</a></div></body></html>"""),
)


def test_labeller_on_plain_pages_written_by_hand(spark):
    """Pages whose markup names nothing, also where the table holds many such pages and few others."""
    pages = [p.replace("#", "") for p in PLAIN_PAGES]
    crawl = [(i, "u", f"<body><div><a href=/>x</a></div><div><p>{prose(30, i)}.</p><p>{prose(20, -i % 97)}.</p></div></body>") for i in range(150)]
    labeller = extract.fit(spark.createDataFrame(crawl, "page_id long, url string, html string"))
    kept = lost = junk = 0
    for marked, page in zip(PLAIN_PAGES, pages):
        truth = ["#" in b.text for b in extract.blocks_of(marked)]
        got = labeller.probabilities([extract.vectors(extract.blocks_of(page))])[0] >= 0.5
        kept, lost, junk = kept + sum(g and t for g, t in zip(got, truth)), lost + sum(t and not g for g, t in zip(got, truth)), \
            junk + sum(g and not t for g, t in zip(got, truth))
    assert kept >= 9 and lost <= 3 and junk <= 2


def test_tags_end_outside_quotes():
    got = [(t.name, t.closing, t.attributes) for t in markup.tags(
        """<p title="a > b" x='>'>1 < 2<a href="x>l</a> <b k="y">don't</B><!-- > --><script>if(a<b)"</p>"</script ><br/><q""")]
    assert got == [("p", False, """ title="a > b" x='>'"""), ("a", False, ' href="x>l</a> <b k="y"'), ("b", True, ""),
                   ("", False, ""), ("", False, ""), ("br", False, "/")]
    page = '<div><a title="a > b" href="x">link</a> text</div>'
    assert warc.plain_text(page) == "link text" and [b.text for b in extract.blocks_of(page)] == ["link text"]


@pytest.mark.parametrize("piece", ["<a", "<a ", '<a "', '<a ="', "<a =' >", "<!", "<!--", "<script ", "<", "</scr", "<a =\" > \" '", "<p>x"])
def test_markup_takes_linear_time(piece):
    page = "<p>" + piece * (200_000 // len(piece))
    begin = time.perf_counter()
    markup_tags = sum(1 for _ in markup.tags(page))
    assert time.perf_counter() - begin < 5 and markup_tags >= 1
    extract.blocks_of(page)
    warc.plain_text(page)
    assert time.perf_counter() - begin < 15


def test_long_pages_are_scored_in_bounded_memory():
    blocks = extract.blocks_of("<article>" + "<p>Some words, as ever.</p>" * 60_000)
    m = extract.new_labeller()
    x = extract.vectors(blocks)
    tracemalloc.start()
    p = m.probabilities([x])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 60_000 and peak < 6 * x.nbytes
    full = extract._forward(m, x[None, :500], np.array([500]))[0][0]
    assert np.allclose(full, m.probabilities([x[:500]])[0], atol=1e-5)


def test_all_words_of_a_block_are_hashed():
    same = " ".join(f"w{i}" for i in range(64))
    a, b = (extract.vectors([extract.Block(("p",), f"{same} {rest}", 0)])[0, extract.PATH:extract.PATH + extract.WORDS]
            for rest in ("one " * 40 + "end", "two " * 40 + "end"))
    assert abs(a - b).sum() > 0.5 and abs(a.sum() - 1) < 1e-5


def test_lstm_gradient():
    rng = np.random.default_rng(3)
    w = rng.normal(0, 0.3, (5 + extract.HIDDEN + 1, 4 * extract.HIDDEN))
    x, up = rng.normal(size=(2, 4, 5)), rng.normal(size=(2, 4, extract.HIDDEN))

    def loss(v):
        return float((extract._scan(v, extract._base(v, x))[0] * up).sum())

    g = extract._scan_gradient(w, x, extract._scan(w, extract._base(w, x))[1], up)
    for i, j in ((0, 3), (7, 20), (-1, 40), (12, 60)):
        d = np.zeros_like(w)
        d[i, j] = 1e-2
        assert abs((loss(w + d) - loss(w - d)) / 2e-2 - g[i, j]) < 2e-2


def test_grading_edges(spark, docs, none):
    grader = grades.Grader(np.zeros(grades.BUCKETS, np.float32), np.array([-1.0, 1.0]))
    got = grades.grade_texts(docs, grader, free_name(docs, "rules"))
    assert got.columns[:-1] == docs.columns and got.count() == docs.count()
    assert grades.grade_texts(none, grader).count() == 0
    labels = spark.createDataFrame([(None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    assert np.all(np.diff(grades.fit(docs, labels).thresholds) > 0)


def test_grades_are_ordered_and_held_out():
    rng = np.random.default_rng(1)
    rows, y = [], rng.integers(0, 3, 600)
    for k in y:
        words = " ".join(f"w{int(v)}" for v in rng.integers(0, 60, 40)) + " bad" * int(k < 2) + " junk" * int(k < 1)
        rows.append(grades.hashed(words.encode(), grades._Buckets()))
    g = grades.fit_grader(rows[:400], y[:400])
    score = np.array([g.weights[a].sum() for a in rows[400:]])
    assert np.mean((g.tails(score) > 0.5).sum(axis=1) == y[400:]) > 0.95
    assert np.all(np.diff(g.thresholds) > 0)


def test_every_part_of_a_word_is_graded():
    cache = grades._Buckets()
    bad = set(grades.hashed(b"idiot", cache)) - set(grades.hashed(b"other", cache))
    assert len(bad) == 1  # the word itself; form and repeats are alike
    for text in (b"l'idiot", b"you/idiot fine", b"one,two,three,four,five,six,idiot,seven", b"x-" * 500 + b"IDIOT"):
        assert bad <= set(grades.hashed(text, cache)), text


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(5, 1), (12, 0), (None, 1), (4, None), (5, 0)], "doc_id long, quality int")
    forest = quality_rules.fit(docs, labels)
    out = free_name(docs, "rules")
    assert out == "rules_1"
    rows = quality_rules.judge(docs, forest, out).select("doc_id", "text", f"{out}.*").collect()
    for r in rows:
        assert tuple(r[2:7]) == brute.quality_counts(r.text)
    assert by_id(quality_rules.judge(docs, forest, out))[1][out].base_failed
    assert quality_rules.judge(none, quality_rules.fit(none, labels), out).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    forest = quality_rules.fit_forest(x[:2000], y[:2000], [1, -1, 0])
    assert np.mean((forest.probability(x[2000:]) > 0.5) == y[2000:]) > 0.9
    line = np.linspace(-3, 3, 200)
    for j, sign in ((0, 1), (1, -1)):
        z = np.zeros((200, 3))
        z[:, j] = line
        assert np.all(sign * np.diff(forest.margin(z)) >= -1e-12)


def test_simhash_edges(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    want = brute.simhash_components(texts)
    assert all((r.fingerprint, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})
    assert ids.count(None) == 1


def test_near_copy_under_the_id_of_another_text_goes(spark):
    prepare(spark)
    a, b = prose(400, 21), prose(400, 22)
    df = spark.createDataFrame([(3, a), (5, a.upper()), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()) == [(3, a), (5, b)]


def test_simhash_links_across_batches_and_splits(spark, monkeypatch):
    prepare(spark)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    made = set(base.tolist())
    for f in base.tolist():
        for _ in range(60):
            made.add(f ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    f = np.array(sorted(made), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.fingerprint_links(df)).collect()}
    links = [(int(a), int(f[i + 1 + j])) for i, a in enumerate(f)
             for j in np.flatnonzero(np.bitwise_count(f[i + 1:] ^ a) <= 3)]
    want = brute.components(links, [int(x) for x in f])
    groups = Counter(want.values())
    mine = Counter(got.get(int(x), int(x)) for x in f.view(np.int64))
    assert sorted(groups.values()) == sorted(mine.values())
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", 16)
    near = np.unique(f[:1] ^ np.array([sum(1 << int(b) for b in rng.choice(32, 3, replace=False)) for _ in range(200)], np.uint64))
    table = simhash.distance_table(near)
    whole = [(int(a), int(b)) for i, a in enumerate(near) for b in near[i + 1:] if bin(int(a) ^ int(b)).count("1") <= 3]
    part = [(int(x), int(y)) for m, r in simhash.link_run(near, table, ((1 << 32) - 1) << 32) for x, y in zip(m, r)]
    nodes = [int(x) for x in near]
    assert brute.components(whole, nodes) == brute.components(part, nodes)


def test_components_of_chains_and_stars(spark):
    prepare(spark)
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}}


def test_suffix_edges(spark, docs, none):
    rows = docs.select("doc_id", "text").collect()
    want = brute.without_repeats([(r.text or "").encode() for r in rows])
    key = Counter((r.doc_id, w[1], w[2], brute.sha(w[0])) for r, w in zip(rows, want))
    got = Counter((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs).collect())
    assert got == key
    assert suffixes.remove_repeats(none).count() == 0
    out = suffixes.deduplicate(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r for r in out.collect()}
    assert text[1].text == "" and text[7].n_chars == len(text[7].text) < 400 and text[5].text == ""
    umlauts = "ö" * 150
    two = suffixes.deduplicate(spark.createDataFrame([(1, "a" + umlauts), (2, "b" + umlauts)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in two.collect()} == {1: "a", 2: "b"}


@pytest.mark.parametrize("length", [60, 120, 199, 205, 340])
def test_frequent_anchors_are_split(spark, monkeypatch, length):
    prepare(spark)
    rng = np.random.default_rng(length)

    def letters(n):
        return bytes(rng.integers(97, 101, n, dtype=np.uint8)).decode()

    phrase, tail = letters(length), letters(170)
    texts = [letters(int(rng.integers(0, 200))) + phrase + (tail[:i] if i % 3 else "") + letters(int(rng.integers(0, 200)))
             for i in range(90)]
    monkeypatch.setattr(suffixes, "SPLIT_ROWS", 8)
    sizes = []
    solve = suffixes._split
    monkeypatch.setattr(suffixes, "_split", lambda hot: [sizes.append(hot.count()), solve(hot)][1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute.without_repeats([t.encode() for t in texts])
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()}
    assert got == {i: (w[1], w[2], brute.sha(w[0])) for i, w in enumerate(want)}
    assert sizes and sizes[0] > 8
    rows = spark.createDataFrame([(7, i, 0, i, 200, bytearray(rng.integers(97, 101, 152, dtype=np.uint8)) + phrase.encode()[:48]
                                   + bytearray(rng.integers(97, 101, 152, dtype=np.uint8))) for i in range(40)],
                                 "kmer long, doc_id long, text_key long, pos int, right short, seg binary")
    cut, _ = solve(rows.withColumn("pos", rows.pos + 152))
    assert max(r["count"] for r in cut.groupBy("kmer").count().collect()) <= 8


@pytest.mark.parametrize("limit", [50, 10_000])
def test_induction_in_memory_and_on_disk(tmp_path, monkeypatch, limit):
    rng = np.random.default_rng(11)
    base = [bytes(rng.integers(97, 101, 700, dtype=np.uint8)) for _ in range(4)]
    texts = []
    for i in range(60):
        a = int(rng.integers(0, 400))
        texts.append(bytes(rng.integers(97, 123, 150, dtype=np.uint8)) + base[i % 4][a:a + 300])
    text, pos, kmer, around = suffixes.find_anchors(texts)
    seg = np.stack([np.frombuffer((bytes(suffixes.LEFT) + texts[t] + bytes(200))[p:p + suffixes.SPAN], np.uint8)
                    for t, p in zip(text, pos)])
    left, right = np.minimum(pos, suffixes.LEFT), np.minimum(450 - pos, 200)
    monkeypatch.setattr(suffixes, "SORT_ROWS", limit)
    most, least = suffixes.repeats_of(seg, kmer.view(np.int64), left, right, str(tmp_path), limit)
    gone = [np.zeros(450, bool) for _ in texts]
    for t, p, m, n in zip(text, pos, most, least):
        if m >= 0:
            gone[t][p - m:p - n + 200] = True
    for (_, removed, _), g in zip(brute.without_repeats(texts), gone):
        assert g.sum() == removed


def test_archive_round_trip(spark):
    schema = "page_id long, url string, html string, record int, refers_to int"
    rows = [(1, "http://a.b/c", "<p>Hi &amp; <b>bye</b><script>x</script>", 1, 1), (2, None, None, 1, 1), (3, "", "é", 1, 1),
            (1, "http://a.b/c", "<p>Hi &amp; <b>bye</b><script>x</script>", 1, 1), (None, "http://x/\nY: z", "<br>" * 9, 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = warc.build_records(df).collect()
    assert len(got) == 15
    stream = b"".join(bytes(r.record) for r in got)
    at = 0
    for r in got:  # records can be read one after the other from their concatenation
        headers, block = warc.parse(stream[at:])
        at += stream[at:].index(b"\r\n\r\n") + 4 + len(block) + 4
        assert headers["WARC-Record-ID"] == r.record_id and headers.get("WARC-Refers-To") == r.refers_to
        assert headers["WARC-Block-Digest"] == r.block_digest == warc.digest(block)
        assert headers.get("WARC-Payload-Digest") == r.payload_digest and len(block) == r.content_length
        if r.record_type == "response":
            assert warc.digest(block.partition(b"\r\n\r\n")[2]) == r.payload_digest
    assert at == len(stream)
    texts = {r.page_id: warc.parse(bytes(r.record))[1].decode() for r in got if r.record_type == "conversion"}
    assert texts[1] == "Hi & bye" and texts[2] == "" and texts[3] == "é"
    assert warc.build_records(df.limit(0)).count() == 0


def test_url_edges(spark):
    prepare(spark)
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("a.example.com", "/en/", "allow"), (None, "/", "block"),
         ("net", None, "block"), ("com", "/", "block"), ("org", "/x", "allow"), ("org", "/x/y", "block")],
        "host string, path string, verdict string")
    urls_ = ["http://EXAMPLE.com/en/x", "https://a.example.com/en/", "notexample.com/en/", "http://b.com", "http://q.net",
             None, "", "http://myexample.com/en/", "ftp://x.org/x/y?z", "ftp://x.org/xz#x/y", "a://b://com/"]
    df = spark.createDataFrame([(i, u, 1, 1) for i, u in enumerate(urls_)] + [(0, urls_[0], 1, 1)],
                               "page_id long, url string, host int, rule int")
    got = urls.judge_urls(df, rules).collect()
    assert len(got) == 12
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert by[1][2:] == ("a.example.com/en/", "allow")
    assert by[2] == ("", "", None, "allow") == by[5] == by[6]
    assert by[3] == ("b.com", "", None, "allow")
    assert by[4][2:] == ("net", "block")
    assert by[7][2:] == ("com/", "block")
    assert by[8] == ("x.org", "/x/y", "org/x/y", "block") and by[9][1:] == ("/xz", "org/x", "allow")
    assert urls.judge_urls(df, rules.limit(0)).where("rule IS NULL").count() == 12
    assert urls.judge_urls(df.limit(0), rules).count() == 0


def test_many_url_rules_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    labels = [chr(97 + i) * int(n) for i, n in zip(range(12), rng.integers(1, 9, 12))]
    hosts = sorted({".".join(rng.choice(labels, rng.integers(1, 5))) for _ in range(400)} | {"", "com."})
    paths = ["", "/"] + ["/" + "/".join(rng.choice(["x", "yy", "zzz"], rng.integers(1, 6))) for _ in range(60)]
    rules = {(str(rng.choice(hosts)), str(rng.choice(paths))): str(rng.choice(["allow", "block"])) for _ in range(2500)}
    asked = [("http://" + ".".join(rng.choice(labels, rng.integers(1, 6))) + str(rng.choice(paths)) + "tail") for _ in range(300)]
    asked += ["http://" + "a." * 5000 + hosts[9] + "/x", "http://com./x", "http:///x"]
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()], "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    want = {}
    for i, u in enumerate(asked):
        host, _, path = u.split("://", 1)[1].partition("/")
        path = "/" + path if "/" in u.split("://", 1)[1] else ""
        fit = [(len(h + p), len(h), v, h + p) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i] = max(fit)[3:1:-1] if fit else (None, "allow")
    for limit in (None, 0):  # broadcast, and shuffled
        if limit is not None:
            monkeypatch.setattr(urls, "small", lambda d: d)
        assert {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, table).collect()} == want


def test_fill_in_middle_edges(spark, docs, none):
    extra = [(20, "a\n\n\nb"), (21, "\n"), (22, "no break"), (23, "ü\n日本\n€uro"), (24, "holds <S> already\nx"), (25, "x\n" * 5000),
             (26, "\n\n"), (27, "<P"), (None, "one\ntwo\n"), (28, "a\r\nb\rc\n")]
    df = docs.select("doc_id", "text", "lang", F.lit("z").alias("fim")).unionByName(
        spark.createDataFrame([(d, t, None, "z") for d, t in extra], "doc_id long, text string, lang string, fim string"))
    made = middle.fill_in_middle(df, out="made").withColumn("back", middle.restored(F.col("made.output"), F.col("made.form")))
    rows = made.collect()
    assert len(rows) == df.count() and made.columns == ["doc_id", "text", "lang", "fim", "made", "back"]
    for r in rows:
        m = r.made
        assert (m.n, m.form, m.prefix_chars, m.middle_chars, m.output) == brute.fill_in_middle(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.made.form for r in rows} == {"plain", "spm", "psm"}
    assert middle.fill_in_middle(none).collect() == []
    assert {r.fim.form for r in middle.fill_in_middle(df, rate=0).collect()} == {"plain"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "x", "<M>"), ("<<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(docs, sentinels=bad)


def test_select_in_words():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.3, 1.0):
        data = np.where(rng.random(1003) < share, 10, rng.integers(0, 256, 1003)).astype(np.uint8)
        marks = middle.Marks(middle.byte_marks(middle.words_of(data), 10))
        at = np.flatnonzero(data == 10)
        assert (marks.select(np.arange(len(at))) == at).all()
        places = np.arange(len(data) + 1)
        assert (marks.rank(places) == np.searchsorted(at, places)).all()


def test_order_minhash_edges(spark, docs, none):
    texts = [t for t, in docs.select("text").distinct().collect()] + [
        " leading and trailing ", "a b c d e", "a b c d e f", "a " * 700, "same words " * 50 + "end", "x\ty\nz w v u t"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(df).collect()}
    assert got == {i: brute.order_minhash(t) for i, t in enumerate(texts)}
    assert got[texts.index(None)] == got[texts.index("")] == ""
    assert order_minhash.edited_fingerprints(none).collect() == []
    # a text of a script without blanks has a unit for each character
    near = spark.createDataFrame([("日本語の文章は単語の間に空白を置かない", "日本語の文章は単語の間に空白を置きます"), ("日本 語", "日本語")], "a string, b string")
    like = near.select(order_minhash.likeness(*[order_minhash.order_minhash(F.col(c)) for c in "ab"]).alias("x")).collect()
    assert 0.2 < like[0].x < 1 and like[1].x == 1


def test_order_minhash_follows_edits_and_order(spark):
    words = prose(900, 31).split()
    near = [*words[:450], *prose(30, 32).split(), *words[480:]]
    rows = [(" ".join(words), " ".join(x)) for x in (words, near, words[450:] + words[:450], prose(900, 33).split())]
    made = spark.createDataFrame(rows, "a string, b string").select(
        order_minhash.likeness(*[order_minhash.order_minhash(F.col(c)) for c in "ab"]).alias("x")).collect()
    same, edited, moved, other = [r.x for r in made]
    assert same == 1 and 0.7 < edited < 1 and moved < edited - 0.2 and other < 0.05


def test_edited_fingerprints(spark, docs):
    numbered = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    df = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "fp")
    assert df.count() == len(numbered) + 1  # one row comes twice
    rows = order_minhash.edited_fingerprints(df).collect()
    assert len(rows) == df.count()
    want = brute.edited(numbered)
    for r in rows:
        text, after = want[r.doc_id]
        own, changed, following = (brute.order_minhash(t) for t in (numbered[r.doc_id], text, numbered[after]))
        assert (r.n_chars, r.edited_sha256) == (len(numbered[r.doc_id] or ""), brute.sha(text.encode()))
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert (r.near_edited, r.near_next) == (brute.share(own, changed), brute.share(own, following))
    odd = spark.createDataFrame([(None, "x y"), (None, "x y"), (None, None), (1, "a b c"), (1, "d e f g h i")], "doc_id long, text string")
    got = order_minhash.edited_fingerprints(odd).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter({(None, 3): 2, (None, 0): 1, (1, 5): 1, (1, 11): 1})
    assert len({(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in got}) == 4
    alone = order_minhash.edited_fingerprints(odd.where("text = 'a b c'")).collect()
    assert [(r.n_chars, r.near_next, r.edited_sha256) for r in alone] == [(5, 1.0, brute.sha(b"a b a"))]


@pytest.mark.parametrize("letters,longest,count", [("ab", 7, 150), ("abc", 9, 250), ("abcdeé", 10, 300)])
def test_two_way_index_finds_all_words_one_edit_away(letters, longest, count):
    rng = np.random.default_rng(count)
    words = sorted({"".join(rng.choice(list(letters), rng.integers(1, longest + 1))) for _ in range(count)})
    index = spelling.TwoWayIndex(words)
    asked = [*words[::2], "zz", "abz", letters * 3]
    for first in (True, False):
        q, w = index.near(asked, first, np.array([x in set(words) for x in asked]))
        want = {(a, b) for a in asked for b in words if brute.one_edit(a, b) and (
            b.startswith(a[:len(a) // 2]) if first else b.endswith(a[len(a) // 2:]))}
        assert {(asked[i], words[j]) for i, j in zip(q, w)} == want and len(q) == len(want)


def test_spelling_variants_equal_brute_force(spark):
    prepare(spark)
    rng = np.random.default_rng(8)
    base = ["color", "colour", "colours", "coloura", "x" * 400, "x" * 399 + "y", "été", "ete", "aaaaaa", "aaaaaaa", "aaaaaaaa", "solo"]
    words = {w: int(rng.integers(1, 400)) for w in base + ["".join(rng.choice(list("abc"), rng.integers(4, 8))) for _ in range(500)]}
    words |= {"chainaa": 625, "chainab": 125, "chainbb": 25, "chainbc": 5, "tiea": 50, "tieb": 50, "tie": 10}
    df = spark.createDataFrame([(w, n, "z") for w, n in words.items()], "word string, n long, form string")
    want = brute.variants(words)
    for rows in (10_000, 40):  # with 40, many halves are dealt over several shards
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df, shard_rows=rows).collect()}
        assert got == want
    assert got["chainbc"][:2] == ("chainbb", "chainaa") and got["tie"][0] == "tiea"
    odd = spark.createDataFrame([("abc", 2), ("abc", 3), (None, 9), ("", 9), ("abd", 100)], "word string, n long")
    assert sorted(tuple(r) for r in spelling.group_variants(odd).collect()) == [
        ("abc", "abd", "abd", 5, 1, 100), ("abd", None, "abd", 100, 1, None)]
    assert spelling.group_variants(odd.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling.group_variants(odd, ratio=1)


def test_a_near_word_counts_once_where_a_half_lies_in_several_shards(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abc"), rng.integers(6, 9))): int(rng.integers(5, 400)) for _ in range(700)}
    words |= {"prefix" + "".join(rng.choice(list("abcd"), rng.integers(2, 6))): int(rng.integers(5, 4000)) for _ in range(300)}
    want = brute.variants(words)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for rows in (25, 60):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df, shard_rows=rows).collect()}
        assert got == want


def test_noisy_words(spark, docs, none):
    import re
    import zlib

    text = "Abcdefg ÀBCDEFé short x-rayed naïvement " + " ".join(f"Wörter{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))
    df = docs.select("doc_id", "text", "term").unionByName(spark.createDataFrame([(77, text, "z"), (None, text, "z")], "doc_id long, text string, term string"))
    want = Counter()
    for r in df.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += len(run) >= 6
    want = {w: n for w, n in want.items() if n >= 1 and len(w) >= 6}
    got = {r.word: r.n for r in spelling.vocabulary(spelling.noisy_words(df), min_count=1).collect()}
    assert got == want and any(w.startswith("örter") or "wrter" in w for w in got)
    assert spelling.noisy_words(none).count() == 0
