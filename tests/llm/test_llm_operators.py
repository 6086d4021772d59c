"""Operators of the subpackage against brute force, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from splatlake.llm import decontaminate, htmltext, jaccard, knn, language, packing, sharding, substrings, toxicity
from splatlake.llm.automaton import SuffixAutomaton
from splatlake.llm.fmindex import FMIndex

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
EDGE = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "One  TWO"), (9006, "word " * 9000), (9007, "same text again"), (9007, "same text again"), (9008, "é à ü " * 30), (9009, "a" * 5000)]


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return found[:150] + EDGE


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With a column whose name clashes with ones that operators make."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text, lower=False):
    data = (text or "").encode()
    return WORD.findall(data.translate(LOWER) if lower else data)


def test_knn(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(400, 8)))] + [(1000 + i, [0.5] * 8) for i in range(120)]
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 6), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [0.25])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(q, x))), j) for j, x in good if j != i)[:5]  # noqa: B905
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert sorted(map(tuple, knn.knn_join(t, t.where("vec_id % 50 = 0"), pivots=16, groups=3).collect())) == sorted(want)
    assert knn.knn_join(t.where("false"), t).count() == 0 and knn.knn_join(t, t.where("false")).count() == 0


def test_knn_repeated_ids(spark, monkeypatch):
    """In clusters, so that bounds prune: rows with a query's own id are no neighbours, however many and wherever."""
    rng = np.random.default_rng(4)
    centre, rows = np.eye(6) * 40, []
    for c in range(6):
        rows += [(1000 * c + i, [float(v) for v in centre[c] + rng.normal(size=6) * (0.01 if i < 3 else 2)]) for i in range(3)]
        rows += [(1000 * c, [float(v) for v in centre[c] + rng.normal(size=6) * 0.01]) for _ in range(30)]
    rows += [(9000 + i, [float(v) for v in 20 * (centre[i % 6] / 40 + centre[(i + 1) % 6] / 40)]) for i in range(12)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = t.where("vec_id % 1000 = 0 AND vec_id < 9000")
    good = [(i, np.floor(256 * np.array(x, np.float32).astype(float)).astype(int)) for i, x in rows]
    query = {i: min((x.astype("<f8").tobytes(), tuple(x)) for j, x in good if j == i)[1] for i in range(0, 6000, 1000)}
    want = []
    for i, q in query.items():
        scores = sorted((-int(np.array(q) @ x), j) for j, x in good if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    for block in (knn.DATA_BLOCK, 20):
        monkeypatch.setattr(knn, "DATA_BLOCK", block)
        assert sorted(map(tuple, knn.knn_join(t, asked, pivots=16, groups=6).collect())) == sorted(want)


def test_language(spark, empty):
    text = spark.read.parquet(f"{SF}/documents.parquet")
    books = language.fit(text)
    assert set(books) == {r[0] for r in text.select("lang").distinct().collect()}
    out = {r.doc_id: r for r in language.predict(text, books).collect()}
    labelled = {r.doc_id: r.lang for r in text.where(language.held_out(text.doc_id)).collect()}
    assert np.mean([out[d].lang_pred == v for d, v in labelled.items()]) > 0.9
    odd = language.predict(spark.createDataFrame(EDGE + [(9100, "123 !!")], "doc_id long, text string"), books).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (9001, 9002, 9003, 9100)} == {"und"} and all(0 <= r.score <= 1 for r in odd)
    assert language.fit(empty) == {} and {r.lang_pred for r in language.predict(text, {}).collect()} == {"und"}


def test_html(spark):
    model = htmltext.default_model()
    pages = htmltext.labelled_pages(150, seed=5)
    found = htmltext.main_texts([p for p, _ in pages], model)
    right = [set(t.split("\n\n")) - {""} == {" ".join(c.split()) for c in content} for t, (_, content) in zip(found, pages, strict=True)]
    assert np.mean(right) > 0.9
    page = "<html><body><nav><a href=/a>Menu here</a></nav><article><h1>A &amp; B</h1><p>First  line<br>goes on &eacute;.<p><b>Second.</p><script>no('<p>')</script></article><footer>&copy; x</footer></body></html>"
    t = spark.createDataFrame([(1, "u", page, 5), (2, "u", None, 5), (3, "u", "", 5), (4, "u", "<p", 5), (5, "u", "<script>x", 5), (1, "u", page, 5)], "page_id long, url string, html string, text int")
    out = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(t, model).collect()}
    assert out[1] == ("A & B\n\nFirst line goes on é.\n\nSecond.", 37)
    assert out[2] == out[3] == out[5] == ("", 0) and htmltext.extract(t.where("false"), model).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(3)
    bad, plain = ["vileword", "nastyone", "horridly"], [f"w{rng.randrange(999)}" for _ in range(400)]
    make = lambda toxic: " ".join(rng.choice(plain) for _ in range(60)) + (" " + rng.choice(bad) + str(rng.randrange(9)) if toxic else "")
    texts = [(make(k % 3 == 0), int(k % 3 == 0)) for k in range(600)]
    model = toxicity.train([t for t, _ in texts[:450]], [y for _, y in texts[:450]])
    p = model.scores([t for t, _ in texts[450:]]) >= 0.5
    assert np.mean(p == np.array([y for _, y in texts[450:]], bool)) > 0.9
    labels = spark.createDataFrame([(d, k % 2, (k + 1) % 2) for k, d in enumerate(range(0, 150))] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.toxicity <= 1 for r in out)
    none = toxicity.fit(empty, labels)
    assert toxicity.score(empty, none).count() == 0 and toxicity.fit(docs, labels.where("false")).scores(["x"])[0] < 0.5


def test_sharding(spark, docs, rows, empty):
    slots = sharding.SlotMap.initial(16)
    more = slots.grown()
    assert all(a == b or b == 16 for a, b in zip(slots.shards, more.shards, strict=True)) and more.shards == sharding.SlotMap.initial(17).shards
    out = sharding.assign_shards(docs, slots, more).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r.slot)
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.N_SLOTS
        assert r["shard"] == slots.shards[key] and r.grown_shard in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    even = slots.rebalanced({k: (k * 7919) % 1000 for k in range(sharding.N_SLOTS)})
    load = np.bincount(even.shards, [(k * 7919) % 1000 for k in range(sharding.N_SLOTS)])
    assert even.version == 2 and load.max() - load.min() <= 0.03 * load.mean()
    stored = slots.table(spark).union(even.table(spark))
    assert sharding.SlotMap.from_table(stored) == even
    assert sharding.assign_shards(empty, slots, more).count() == 0 and sharding.rebalance(docs, slots).n_shards == 16


def removed(rows, window=35):
    every = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, every, strict=True):
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


def test_substrings(spark, docs, rows, empty):
    assert sorted(map(tuple, substrings.digests(docs).collect())) == removed(rows)
    rng, more, k = random.Random(3), [], 0
    for _ in range(15):
        base = [f"v{rng.randrange(4000)}" for _ in range(120)]
        for _ in range(rng.randrange(2, 5)):
            a = rng.randrange(60)
            part = base[a : a + rng.choice([30, 34, 35, 36, 50, 60])]
            more.append((k, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(20))] + part + [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(20))])))
            k += 1
    twice = "solo " + " ".join(f"m{i}" for i in range(40))
    more += [(k, "a " * 50), (k + 1, "a b " * 40), (k + 2, "x y z " * 11), (k + 3, twice), (k + 3, twice), (k + 4, "a " * 35), (k + 5, " ".join(f"r{i % 7}" for i in range(100))), (None, twice)]
    t = spark.createDataFrame(more, "doc_id long, text string").repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, substrings.digests(t).collect()), key=key) == sorted(removed([r if r[0] is not None else (-1, r[1]) for r in more]), key=key)[1:] + [(None, *[r for r in removed([r if r[0] is not None else (-1, r[1]) for r in more]) if r[0] == -1][0][1:])]
    clean = {r.doc_id: r.text for r in substrings.drop_repeats(docs).collect()}
    want = {r[0]: r[1] - r[2] for r in removed(rows)}
    assert all(len(words(clean[d])) == n for d, n in want.items()) and clean[9001] is None
    assert substrings.digests(empty).count() == 0 and substrings.drop_repeats(empty).columns == docs.columns


def test_known_reference(spark):
    ref = " ".join(f"k{i}" for i in range(100))
    t = spark.createDataFrame([(1, "x y " + " ".join(f"k{i}" for i in range(10, 60)) + " z"), (2, "k1 k2"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.remove_known(t, spark.createDataFrame([(ref,)], "text string")).collect()}
    assert out == {1: [(2, 52)], 2: [], 3: []}
    parts = substrings.remove_known(t, spark.createDataFrame([(ref,), (None,), ("x y " + ref[:3],)], "text string"), part_words=20, block_bytes=900)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in parts.collect()} == out
    assert {len(r.spans) for r in substrings.remove_known(t, spark.createDataFrame([], "text string")).collect()} == {0}


def test_automaton():
    rng = random.Random(1)
    texts = [[rng.randrange(3) for _ in range(30)] for _ in range(4)]
    a = SuffixAutomaton()
    for t in texts:
        a.add(t)
    a.close()
    count = lambda s: sum(t[i : i + len(s)] == s for t in texts for i in range(len(t) - len(s) + 1))
    probe = [rng.randrange(3) for _ in range(60)]
    sizes, counts = a.matching_statistics(probe, 8)
    for e in range(60):
        best = max(n for n in range(9) if n <= e + 1 and (n == 0 or count(probe[e + 1 - n : e + 1])))
        assert sizes[e] == best and (not best or counts[e] == count(probe[e + 1 - best : e + 1]))


def components(rows):
    sets = defaultdict(set)
    n = []
    for d, t in rows:
        w = words(t, True)
        own = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])
        sets[d].add(own)
        n.append((d, len(own)))
    up = {d: d for d in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    post, flat = defaultdict(list), [(d, s) for d in sorted(sets) for s in sets[d]]
    for i, (d, s) in enumerate(flat):
        common = Counter(j for x in s for j in post[x])
        for x in s:
            post[x].append(i)
        for j, c in common.items():
            if 100 * c >= 90 * (len(s) + len(flat[j][1]) - c) and root(d) != root(flat[j][0]):
                a, b = root(d), root(flat[j][0])
                up[max(a, b)] = min(a, b)
    return sorted((d, k, root(d)) for d, k in n)


def test_jaccard(spark, docs, rows, empty):
    assert sorted(map(tuple, jaccard.similar_documents(docs).collect())) == components(rows)
    rng, more, k = random.Random(5), [], 0
    for n in (1, 2, 5, 9, 10, 11, 12, 15, 19, 20, 30, 60):
        base = [f"w{n}x{j}" for j in range(n + 2)]
        for v in range(6):
            w = list(base)
            for _ in range(v % 4):
                p = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
                w.pop(p) if rng.random() < 0.5 else w.insert(p, f"z{rng.randrange(9)}")
            more.append((k, " ".join(w).upper() if v == 5 else " ".join(w)))
            k += 1
    base = [f"b{j}" for j in range(150)]
    for _ in range(200):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(150)] = f"q{rng.randrange(99999)}"
        more.append((k, " ".join(w)))
        k += 1
    out = jaccard.similar_documents(spark.createDataFrame(more, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, out.collect())) == components(more)
    assert jaccard.similar_documents(empty).count() == 0
    kept = {r.doc_id for r in jaccard.drop_similar(docs).collect()}
    assert kept == {c for _, _, c in components(rows)}


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (3, 90), (4, 70)])
def test_jaccard_parameters(spark, shingle, percent):
    rng, rows, k = random.Random(7), [], 0
    for n in (1, 3, 4, 5, 6, 8, 9, 12, 20, 40, 100, 300):
        base = [f"w{n}x{j}" for j in range(n + 4)]
        for v in range(12):
            w = list(base)
            for _ in range(v * n // 150 + v % 3):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((k, " ".join(w[: len(w) - v % 2])))
            k += 1
    sets = [{tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or {tuple(w)} for w in (t.split() for _, t in rows)]
    up = list(range(k))
    for i in range(k):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    assert len(set(up)) < k
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.similar_documents(t, shingle, percent).collect())) == [(d, len(sets[d]), up[d]) for d in range(k)]


def test_pipeline_near_copies(spark):
    """Copies with a 5-word similarity between 0.8 and what 3 words and 0.9 ask for are near copies to the pipeline."""
    import corpus_pipeline

    base = [f"b{j}" for j in range(200)]
    near = [f"q{j}" if j in (20, 70, 120, 170) else w for j, w in enumerate(base)]
    far = [f"q{j}" if j % 33 == 5 else w for j, w in enumerate(base)]
    t = spark.createDataFrame([(4, " ".join(near)), (3, " ".join(base)), (5, " ".join(far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, t, "").collect()) == [3, 5]


def test_drop_similar_rows(spark):
    """Rows are counted: one of repeated rows stays, with and without a doc_id, and none is lost with the copies."""
    from corpus_pipeline import cut_repeats

    a, b, c, d = (" ".join(f"{x}{j}" for j in range(60)) for x in "abcd")
    rows = [(7, a, "en"), (7, a, "en"), (7, a, "de"), (9, a, "en"), (None, a, "en"), (None, b, "en"), (None, b, "en"), (None, b + " x", "en"), (7, c, "en"), (8, d, "en"), (8, d, "en")]
    rows += [(20, None, "en"), (20, None, "en"), (None, None, "en"), (None, "", "en"), (None, "", "en"), (21, "", "en")]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    order = lambda r: tuple((x is None, x or "") if k else (x is None, x or 0) for k, x in enumerate(r))
    got = sorted(map(tuple, jaccard.drop_similar(t, 5, 80).collect()), key=order)
    kept_b = next(r[1] for r in got if r[0] is None and r[1] and r[1].startswith("b0"))
    want = [(7, a, "de"), (7, c, "en"), (8, d, "en"), (20, None, "en"), (21, "", "en"), (None, "", "en"), (None, kept_b, "en"), (None, None, "en")]
    assert got == sorted(want, key=order) and kept_b in (b, b + " x")
    after = cut_repeats(spark, jaccard.drop_similar(t, 5, 80), "").collect()
    assert sorted(map(tuple, after), key=order) == got


def test_jaccard_blocks(monkeypatch):
    rng = random.Random(2)
    base = list(range(100))
    sets = [np.unique(np.array([v if rng.random() > 0.03 else rng.randrange(10**6) for v in base], np.uint64)) for _ in range(90)]
    side = np.array([k % 2 for k in range(90)])
    for two in (False, True):
        up = list(range(90))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(90):
            for j in range(i):
                c = len(np.intersect1d(sets[i], sets[j]))
                if (not two or side[i] != side[j]) and 190 * c >= 90 * (len(sets[i]) + len(sets[j])):
                    up[root(i)] = root(j)
        want = {frozenset(k for k in range(90) if root(k) == r) for r in {root(k) for k in range(90)}}
        u = jaccard._Union(np.arange(90))
        for a, b in jaccard.connect(sets, side if two else np.zeros(90, int)):
            u.join(a, b)
        assert {frozenset(k for k in range(90) if u.root(k) == r) for r in {u.root(k) for k in range(90)}} == want


def leaks(rows, items):
    alnum = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: alnum.findall((t or "").encode().translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        if i is not None:
            for k in range(max(1, len(w) - 9)) if w else ():
                windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("blocks", [1 << 22, 2000])
def test_decontamination(spark, docs, rows, empty, monkeypatch, blocks):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", blocks)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(901, "One two"), (902, None), (903, ""), (None, "word"), (904, "é"), (905, "word word word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.scan_documents(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = leaks(rows, items)
    assert sorted(map(tuple, out.collect())) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert {r.doc_id: r.text for r in clean.collect() if not dict((w[0], w[5]) for w in want)[r.doc_id]} == {d: t for d, t in rows if not dict((w[0], w[5]) for w in want)[d]}
    assert decontaminate.scan_documents(empty, bench).count() == 0
    assert decontaminate.scan_documents(docs, bench.where("false")).where("contaminated").count() == 0


def test_fm_index():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 500)
    index = FMIndex(text, 9)
    for n in (1, 3, 6):
        probes = rng.integers(1, 8, (40, n))
        low, high = index.search(probes)
        for p, a, b in zip(probes, low, high, strict=True):
            want = [i for i in range(500 - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t, out, places = Tokenizer.from_file(path), packing.pack_documents(docs, path).collect(), defaultdict(list)
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            want[d, k // 4096, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    lengths, rooms = sorted((r.length for r in out), reverse=True), []
    for n in lengths:  # best fit decreasing, plainly
        fit = min((k for k, room in enumerate(rooms) if room >= n), key=lambda k: rooms[k], default=None)
        if fit is None:
            rooms.append(4096)
            fit = len(rooms) - 1
        rooms[fit] -= n
    assert len(places) == len(rooms)
    assert packing.pack_documents(empty, path).count() == 0
    odd = ["It's 3,4 x.y. don't...", "<|endoftext|> a<|startoftext|>b", "é,\tÀ. ΑΣ. ß", "ﬁ Ǆ", ""]
    encode = packing.encoder(path)
    assert encode.by_words
    for by_words in (True, False):
        encode.by_words = by_words
        assert all(encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd)
    encode.by_words = True


def test_packing_encodes_many_texts_at_once(monkeypatch):
    """Ids are the tokenizer's; new words of many texts reach it in a few calls, and words met before in none."""
    from tokenizers import Tokenizer

    path, rng = packing.tokenizer_path(), random.Random(8)
    t, encode = Tokenizer.from_file(path), packing.WordEncoder(path)

    def want(texts):
        return [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]

    # Lower case composes (J with a caron), makes special tokens, and ends otherwise (sigma); marks before blanks, inside words and after accents.
    odd = ["J\u030c W\u030a. T\u0308,", "<|EndOfText|> x<|ENDOFTEXT|>, <|endoftext|>. a<|startoftext|>!!", "A\u03a3. \u03a3a\u03a3, \u0130", "it's 'S, x'LL. ok''", "a*** b.&&& c.d. \u00e9### e\u0301. 1. 2,,", "", " \t\r\n", "a\u00a0b\x0bc\tD\re"]
    parts = [*"aAzZstJWT'.,;*#<>|_1 \n\t\r", "\u030c", "\u030a", "\u03a3", "\u0130", "\u00df", "\u00c9", "\u0338", "\u00a0", "\u4e2d", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL"]
    odd += ["".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(3000)]
    assert encode.by_words and encode.encode_texts(odd) == want(odd)
    assert [packing.WordEncoder(path)(x) for x in odd[:8]] == want(odd[:8])
    texts = [" ".join("".join(rng.choices("abcdefgh\u00e9", k=9)) + rng.choice(["", ".", ","]) for _ in range(60)) for _ in range(300)]
    calls = Counter()

    class Counted:
        def __init__(self, name, inner):
            self.name, self.inner = name, inner

        def encode_batch_fast(self, *args, **options):
            calls[self.name] += bool(args[0])
            return self.inner.encode_batch_fast(*args, **options)

    encode.lines, encode.tokenizer = Counted("lines", encode.lines), Counted("words", encode.tokenizer)
    first = encode.encode_texts(texts)
    assert first == want(texts) and calls["lines"] == 1 and calls["words"] <= 1
    calls.clear()
    assert encode.encode_texts(texts[::-1]) == first[::-1] and not calls
    monkeypatch.setattr(packing, "LINES", 50)
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    for line_end in (encode.line_end, []):  # in small lots, and as if the vocabulary had no line end
        encode.memo, encode.line_end = {}, line_end
        assert [x for k in range(0, 300, 40) for x in encode.encode_texts(texts[k : k + 40])] == first
    monkeypatch.setattr(packing, "SLICE_BYTES", 40)
    texts = [None if n is None else "x" * n for n in (3, None, 41, 90, 20, 20, 20, 0, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    cut = [x.to_pylist() for x in packing.slices(batch)]
    assert sum(cut, []) == batch.to_pylist() and len(cut) > 3
    assert all(sum(len(r["text"] or "") for r in x[1:]) < 40 for x in cut)
    assert not sum((x.to_pylist() for x in packing.slices(batch.slice(0, 0))), [])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_jaccard_large_components(spark, monkeypatch):
    """Chains of links over many blocks: representatives, then what they left apart; frequent passages in unlike texts."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    monkeypatch.setattr(jaccard, "REPRESENTATIVES", 2)
    rng = random.Random(11)
    passage = [f"p{j}" for j in range(30)]
    rows = [(k, " ".join([f"u{rng.randrange(10**6)}" for _ in range(60)] + passage)) for k in range(60)]
    base = [f"b{j}" for j in range(80)]
    for k in range(100, 220):  # each near the one before it, the ends far apart
        base = list(base)
        base[(3 * k) % 80] = f"c{rng.randrange(10**6)}"
        rows.append((k, " ".join(base)))
    for k in range(300, 360):
        w = list(base)
        w[rng.randrange(80)] = f"d{rng.randrange(10**6)}"
        rows.append((k, " ".join(w[: 80 - rng.randrange(3)])))
    rng.shuffle(rows)
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(map(tuple, jaccard.similar_documents(t).collect()))
    assert out == components(rows) and len({c for _, _, c in out}) < 130


def test_jaccard_prefixes():
    """Similar sets meet at a token within the sizes that both give, under any counts; a long text has no more keys than its share."""
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 256, jaccard.SLOTS).astype(np.uint8)
    for percent in (70, 80, 90):
        for n in (4, 9, 10, 25, 100, 400):
            for _ in range(30):
                a = rng.integers(0, 1 << 60, n).astype(np.uint64)
                b = np.concatenate([a[rng.random(n) > 0.08], rng.integers(0, 1 << 60, int(rng.integers(0, n // 8 + 2))).astype(np.uint64)])
                a, b = np.unique(a), np.unique(b)
                common = len(np.intersect1d(a, b))
                if 0 < common and 100 * common >= percent * (len(a) + len(b) - common) and (len(a) != common or len(b) != common):
                    (x, up_x), (y, up_y) = jaccard.prefix(a, levels, percent), jaccard.prefix(b, levels, percent)
                    meet = [(i, j) for i, v in enumerate(x) for j in np.flatnonzero(y == v)]
                    assert any(len(b) <= up_x[i] and len(a) <= up_y[j] for i, j in meet)
                    x, y = jaccard.bitmap(a, percent), jaccard.bitmap(b, percent)
                    least = min(len(x), len(y))
                    assert (jaccard.folded(x, least) ^ jaccard.folded(y, least)).bit_count() <= len(a) + len(b) - 2 * common
    assert len(jaccard.prefix(np.arange(10**6, dtype=np.uint64), levels, 80)[0]) == 200_001


def test_jaccard_counts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    rows = [(k, "the same five words here " + " ".join(f"x{k}y{j}" for j in range(4))) for k in range(400)]
    t = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    scanned = t.mapInArrow(lambda b: jaccard._scan(b, 3), "doc_id long, n long, f1 long, f2 long, bits binary, part int, counts binary").where("part IS NOT NULL")
    levels = jaccard._levels(scanned.select("part", "counts"))
    want = np.zeros(jaccard.SLOTS, int)
    import pyarrow as pa

    for _, tokens in jaccard.token_sets(pa.array([r[1] for r in rows]), 3):
        want += np.bincount(jaccard._slot(jaccard._mixed(tokens)), minlength=jaccard.SLOTS)
    assert want.max() >= 400 and (levels == np.minimum(255, 8 * np.log2(1 + want)).astype(np.uint8)).all()


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_jaccard_runs(step):
    """Small runs are lists; a row that stands for many, or a run that gets large, means edges to the first, over batches of any size."""
    import pyarrow as pa

    rng = random.Random(step)
    rows, lists, edges = [], set(), set()
    for key in range(40):
        docs, size, upto, run = rng.sample(range(1000), rng.choice([1, 2, 5, 64, 65, 90])), 10, 0, []
        for d in docs + [None]:
            size += rng.choice([0, 0, 0, 1])
            if d is None or run and size > upto:
                own = [r[3] for r in run]
                if len(run) > jaccard.SMALL or any(r[5] for r in run):
                    edges |= {(x, own[0]) for x in own if x != own[0]}
                elif len(run) > 1:
                    lists.add(tuple(own))
                run, upto = [], 0
            if d is not None:
                run.append((key, size, size + rng.choice([-1, 0, 1, 2]), d, None, rng.random() < 0.01))
                upto = max(upto, run[-1][2])
                rows.append(run[-1])
    rows.insert(len(rows) // 2, (rows[len(rows) // 2][0], 0, 0, 5000, 5001, False))
    edges.add((5000, 5001))
    names = ["key", "size", "upto", "doc", "leader", "many"]
    kinds = [pa.int64()] * 5 + [pa.bool_()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[k : k + step]], t) for i, t in enumerate(kinds)], names) for k in range(0, len(rows), step)]
    out = [r for b in jaccard._meet(iter(batches)) for r in b.to_pylist()]
    assert {tuple(r["docs"]) for r in out if r["docs"]} == lists and {(r["a"], r["b"]) for r in out if r["a"] is not None} == edges
    assert lists and len(edges) > 100
