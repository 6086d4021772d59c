"""Queries that SQL cannot express and stages of the pipeline, against plain versions written anew."""

import base64
import hashlib
import itertools
import json
import random
import re
import time
import uuid
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from splatlake.llm import htmltext, knn, language, queries, toxicity, warc
from splatlake.llm.words import Scanner, mix

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


# Language identification


def plain_language(text, books):
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, sizes = text.encode(), {}
    for lang, book in books.items():
        d = zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        at = sizes[lang] = 0
        while at < len(data):
            end = at + 2048
            while end < len(data) and 0x80 <= data[end] < 0xC0:
                end += 1
            c = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] += len(c.compress(data[at:end]))
            at = end
    ranked = sorted(sizes, key=lambda x: (sizes[x], x))
    second = sizes[ranked[1]]
    margin = (second - sizes[ranked[0]]) / second
    return ranked[0], min(1.0, 0.5 + 2 * margin)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    books = language.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(None, "la casa es de los dos"), (7001, None), (7002, "² ½ ① Ⅷ 12"), (7003, "ß"), (7004, "Das ist ein Satz. " * 30_000)]
    t = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, score int")
    out = sorted([(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.predict(t, books).collect()], key=key)
    want = [(d, *plain_language(x, books)) for d, x in rows]
    assert out == sorted([(d, lang, round(s, 9)) for d, lang, s in want], key=key)
    whole = queries.op2_language_id(spark, SF).collect()
    assert len(whole) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in whole)
    assert [r.h for r in t.where("doc_id IS NULL").select(language.held_out(t.doc_id).alias("h")).collect()] == [False]


def test_many_languages(spark, monkeypatch):
    """No label is dropped, and what is learned of a text lies anywhere in it."""
    rows = [(k, f"l{k % 700:03}", f"word{k % 700} " * 5) for k in range(2800)]
    t = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(language.fit(t)) == [f"l{k:03}" for k in range(700)]
    monkeypatch.setattr(language, "TOTAL", 1 << 18)
    with pytest.raises(ValueError):
        language.fit(t)
    text = " ".join(f"{a}{b}" for a in range(40) for b in range(400))
    book = language.fit(spark.createDataFrame([(1, "x", text)], "doc_id long, lang string, text string"))["x"]
    places = [text.find(p.decode()) for p in book.split(b"\n") if p]
    assert min(places) >= 0 and max(places) > len(text) // 2 and len(book) <= 200 * 516


# HTML extraction


def test_messages():
    """Marginals of the sum-product pass are those of enumerating all states."""
    rng = np.random.default_rng(8)
    for _ in range(12):
        forest = htmltext.Forest()
        for page in range(3):
            first = len(forest.parent)
            for k in range(int(rng.integers(1, 11))):
                parent = -1 if not k else first + int(rng.integers(0, k))
                forest.node(parent, int(rng.integers(0, htmltext.RUN + 1)), (), "x" * int(rng.integers(1, 99)), 0, page)
        model = htmltext.TreeModel(rng.normal(size=(htmltext.N_FEATURES, 2)), rng.normal(size=(len(htmltext.BLOCKS) + 1, 2, 2)))
        x = forest.features().astype(float)
        found, edges = model.infer(forest, x)
        for page in range(3):
            own = [i for i, p in enumerate(forest.page) if p == page]
            total, node, edge = 0.0, np.zeros(len(own)), np.zeros((len(own), 2, 2))
            for states in itertools.product((0, 1), repeat=len(own)):
                energy = 0.0
                for i, s in zip(own, states, strict=True):
                    energy += s * (x[i] @ model.unary[:, int(forest.kind[i] == htmltext.RUN)])
                    if forest.parent[i] >= 0:
                        energy += model.pair[forest.kind[i], states[forest.parent[i] - own[0]], s]
                p = np.exp(energy)
                total += p
                node += p * np.array(states)
                for k, i in enumerate(own):
                    if forest.parent[i] >= 0:
                        edge[k, states[forest.parent[i] - own[0]], states[k]] += p
            assert np.allclose(found[own], node / total)
            inner = [k for k, i in enumerate(own) if forest.parent[i] >= 0]
            assert np.allclose(edges[own][inner], edge[inner] / total)


PAGES = [
    ("<article><header><h1>The title of it</h1></header><p>First paragraph with some words in it.</p><p>Second paragraph with other words.</p></article>", "The title of it|First paragraph with some words in it.|Second paragraph with other words."),
    ("<article><p class='body-text'>One paragraph with words in it.</p><p class='body-text'>And two more of them.</p><div class='comment'>Nice one!</div></article><footer>x</footer>", "One paragraph with words in it.|And two more of them."),
    ("<article><h1>T</h1><p>Words and words in here.</p><figure><img src=x><figcaption>A caption of a picture.</figcaption></figure><dl><dt>Term</dt><dd>Meaning of it.</dd></dl></article>", "T|Words and words in here.|A caption of a picture.|Term|Meaning of it."),
    ("<form><input list=d><datalist id=d><option value=a><option value=b></datalist></form><article><h1>Head</h1><p>Words and words in here.</p><p>More words.</p></article>", "Head|Words and words in here.|More words."),
    ("<datalist><option value=a><option value=b><article><h1>Head</h1><p>Words and words in here.</p><p>More words.</p></article>", "Head|Words and words in here.|More words."),
    ("<article><h1>Head</h1><p title=it's>Words and words in here.</p><p>Don't stop.</p></article>", "Head|Words and words in here.|Don't stop."),
    ("<article><h1>Head</h1><video src=x><p>Words of 3 &lt; 4 and 4 < 5 <math><mi>x</mi></math> here.</p><button>No</button><svg><text>no</text></svg><p>More words of it.</p></article>", "Head|Words of 3 < 4 and 4 < 5 x here.|More words of it."),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_ordinary_pages(page, want):
    assert htmltext.main_texts([page], htmltext.default_model()) == [want.replace("|", "\n\n")]


@pytest.mark.parametrize("part", ["<a '", "<div></section>", "<!--", '<a ="', "<td><li>", "<p x='>", "<video></p>", "<script>", "<script></script ", "<![CDATA[", "</", "<b x=\"'", "&amp", "<option><template>"])
def test_long_odd_pages(part):
    began = time.time()
    htmltext.Forest().add(part * (1_000_000 // len(part)), 0)
    assert time.time() - began < 6


def test_unseen_layouts():
    """Trained without some wrappings of the main part, pages in these are mostly read right."""
    held = htmltext.WRAPS[3::4]
    model = htmltext.train(htmltext.labelled_pages(200, wraps=tuple(w for w in htmltext.WRAPS if w not in held)))
    pages = htmltext.labelled_pages(90, seed=77, wraps=held)
    found = htmltext.main_texts([p for p, _ in pages], model)
    blocks = [(set(t.split("\n\n")) - {""}, {" ".join(c.split()) for c in content}) for t, (_, content) in zip(found, pages, strict=True)]
    shared, kept, true = (sum(len(x) for x in y) for y in ([a & b for a, b in blocks], [a for a, _ in blocks], [b for _, b in blocks]))
    assert shared > 0.9 * kept and shared > 0.8 * true


def test_pages_query(spark):
    """Pages of the tables, whose main part is their article, by another parser."""

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.depth, self.skip = [[]], 0, 0

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.skip += tag in ("script", "style")
            if tag in ("p", "h1"):
                self.blocks.append([])
            if tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.skip -= tag in ("script", "style")
            if tag in ("p", "h1"):
                self.blocks.append([])

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.blocks[-1].append(data)

    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = {r.page_id: r for r in queries.op3_html_extraction(spark, SF).collect()}
    assert out.keys() == source.keys()
    for page, html in source.items():
        parser = Article()
        parser.feed(html or "")
        want = "\n\n".join(t for t in (" ".join("".join(b).split()) for b in parser.blocks) if t)
        assert (out[page].text, out[page].n_chars) == (want, len(want))


# Toxicity


def plain_score(text, model):
    """By words and n-grams one by one."""
    words = ALNUM.findall((text or "").lower().encode().translate(LOWER))
    best = None
    for k in range(0, len(words), toxicity.SEGMENT):
        weights = []
        for word in words[k : k + toxicity.SEGMENT]:
            whole = Scanner(hashed=True).words(0, np.frombuffer(word, np.uint8), np.array([0, len(word)])).hash[0]
            weights.append(float(model.weight[int(whole) % toxicity.BUCKETS]))
            marked = b" " + word + b" "
            for n in toxicity.NGRAMS:
                for i in range(len(marked) - n + 1):
                    if len(marked) == n:  # marks at both ends are the word itself
                        continue
                    value = 0
                    for byte in marked[i : i + n]:
                        value = (value * 257 + byte) & MASK
                    bucket = int(mix(np.array([(value + (n << 56)) & MASK], np.uint64))[0]) % toxicity.BUCKETS
                    weights.append(float(model.weight[bucket]))
        logit = sum(weights) / len(weights) + model.bias
        best = logit if best is None else max(best, logit)
    return 1 / (1 + np.exp(-(model.bias if best is None else best)))


def test_toxicity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(2)
    model = toxicity.ToxicityModel(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.4)
    rows = [(r.doc_id, r.text) for r in docs.limit(25).collect()] + [(None, "A few words here"), (8001, None), (8002, ""), (8003, "?!"), (8004, "Éà ü a b"), (8005, "x y " * 9000)]
    t = spark.createDataFrame([(d, x, 1) for d, x in rows], "doc_id long, text string, score int").repartition(3)
    out = sorted([(r.doc_id, r.toxicity) for r in toxicity.score(t, model).collect()], key=key)
    for (a, x), (b, y) in zip(out, sorted([(d, plain_score(x, model)) for d, x in rows], key=key), strict=True):
        assert a == b and abs(x - y) < 1e-4
    assert [r.h for r in t.where("doc_id IS NULL").select(toxicity.held_out(t.doc_id).alias("h")).collect()] == [False]


def test_long_toxic_texts(spark):
    """Labels of long texts are learned: here all toxic texts are beyond any length of the clean ones."""
    rng = random.Random(9)
    plain = [f"w{rng.randrange(3000)}" for _ in range(3000)]

    def say(parts, bad):
        return " ".join(" ".join(rng.choice(plain) for _ in range(50)) + (f" vileword nastyone {rng.choice(plain)} horridly" if bad else "") for _ in range(parts))

    rows = [(k, say(16 if k % 2 else 3, k % 2)) for k in range(300)]
    assert min(len(t) for k, t in rows if k % 2) > 4096
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = model.scores([say(2, k % 2) for k in range(60)]) >= 0.5
    assert np.mean(found == np.array([k % 2 for k in range(60)])) > 0.9
    held = queries.op4_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in held)


# Top-k


def test_large_components(spark):
    """Components of any finite size, and rows of one id that are pivots too."""
    rows = [(0, [1e8, 1.0]), (1, [1e8, 2.0]), (2, [-1e8, 3.0]), (3, [1e12, 0.25]), (4, [0.1, 0.2]), (50, [3e15, -1e15]), (51, [2.0**200, 1.0]), (52, [0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(256 * np.float64(v))) for v in x] for i, x in rows}
    want = []
    for q in (0, 50):
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], x, strict=True)))), i) for i, x in whole.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, knn.knn_join(t, t.where("vec_id % 50 = 0"), k=3).collect())) == sorted(want)
    many = [(50, [1.0, 0.1 * k]) for k in range(30)] + [(100 + k, [0.9, 0.2 * k]) for k in range(40)]
    t = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    for pivots in (None, 400):
        assert knn.knn_join(t, t.where("vec_id = 50"), pivots=pivots).count() == 5
    report = knn.plan_report(t, t.where("vec_id = 50"))
    assert [g for g, _, _ in report] == list(knn.GROUPS) and all(0 <= share <= 1.001 for _, _, share in report)


# WARC derivatives


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.title, self.inside = [], [], False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title"
        place = {"a": "href", "img": "src", "script": "src", "link": "href", "iframe": "src", "form": "action"}.get(tag)
        for name, value in attrs:
            if name == place:
                self.found.append({"path": f"{tag}@/{name}", "url": value or ""})

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)


def test_derivatives_query(spark, tmp_path):
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    name = lambda kind, source: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(None, "http://n/", "<p>null id</p>"), (1, None, None), (1, None, None)], pages.schema)
    pages.union(more).write.parquet(str(tmp_path / "pages.parquet"))
    texts = Counter()
    for r in queries.op3_html_extraction(spark, str(tmp_path)).collect():
        texts[r.page_id, r.url, r.text] += 1
    main = {(p, u): t for p, u, t in texts}
    out = Counter(map(tuple, queries.op8_warc_derivatives(spark, str(tmp_path)).collect()))
    want = Counter()
    for r in pages.union(more).collect():
        body = (r.html or "").encode()
        content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
        own, ids = name("response", f"{r.page_id} {r.url}"), {}
        for kind in ("metadata", "conversion"):
            ids[kind] = name(kind, own)
        headers = {"WARC-Type": "response", "WARC-Record-ID": own, "WARC-Target-URI": r.url or "", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Block-Digest": sha(content), "WARC-Payload-Digest": sha(body), "Content-Length": str(len(content))}
        if r.page_id is not None:
            headers["X-Page-ID"] = str(r.page_id)
        parser = Links()
        parser.feed(r.html or "")
        meta = {
            "Envelope": {"WARC-Header-Metadata": headers, "Block-Digest": sha(content), "Payload-Digest": sha(body)},
            "HTTP-Response-Metadata": {"Status": "HTTP/1.1 200 OK", "Headers": [["Content-Type", "text/html; charset=utf-8"]], "Entity-Length": len(body), "Entity-Digest": sha(body)},
            "HTML-Metadata": {"Title": " ".join("".join(parser.title).split()), "Links": parser.found},
        }
        for kind, other, block in (("metadata", "conversion", json.dumps(meta, ensure_ascii=False)), ("conversion", "metadata", main[r.page_id, r.url])):
            want[r.page_id, kind, ids[kind], own, ids[other], r.url or None, sha(body), sha(block.encode()), len(block.encode()), block] += 1
    assert out == want


def test_odd_files():
    good = warc.serialize({"WARC-Type": "response", "Content-Length": "3"}, b"abc")
    read = lambda data: [(h["WARC-Type"], c) for h, c in warc.parse_records(data)]
    import gzip

    one, bad = ("response", b"abc"), "unreadable"
    assert read(good + b"junk\r\n" + good) == [one, (bad, b"junk\r\n"), one]
    assert [k for k, _ in read(good.replace(b": 3", b": 99999") + good)] == [bad, "response"]
    assert [k for k, _ in read(good.replace(b": 3", b": x") + good + good)] == [bad, "response", "response"]
    packed = gzip.compress(good)
    broken = bytearray(packed)
    broken[20:30] = b"\xff" * 10
    kinds = [k for k, _ in read(bytes(broken) + packed + packed)]
    assert kinds[-2:] == ["response", "response"]
    assert read(packed + packed[:20] + packed)[0] == one and read(packed + packed[:20] + packed)[-1] == one
    assert read(b"") == [] and [k for k, _ in read(b"no record at all")] == [bad]


# The pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic texts, near copies, repeated rows and passages, and items of the benchmark."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    vocabulary = [word() for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels, items = [], [], [(k, say(rng.choice([6, 14, 30]))) for k in range(12)] + [(98, None), (99, "")]
    for k in range(420):
        toxic = k % 4 == 0
        text = say(rng.randrange(20, 140)) + (f" vileword {rng.choice(vocabulary)} nastyone horridly vileword " if toxic else " ") + say(12)
        rows.append((k, text, "en", "s", len(text)))
        if k < 380:
            labels.append((k, 1, int(toxic)))
    passage = say(60)
    for k in range(500, 530):
        kind = k % 6
        base = rows[4 * (k - 500) + 1][1]
        w = base.split()
        if kind == 0:
            text = base
        elif kind == 1:
            w[rng.randrange(len(w))] = "changedword"
            text = " ".join(w)
        elif kind == 2:
            text = f"{say(50)} {passage} {say(40)}"
        elif kind == 3:
            text = f"{say(30)}\n{items[k % 12][1].upper()}, {say(30)}"
        elif kind == 4:
            text = rng.choice(["", " \n", None, "short one"])
        else:
            text = say(5000)
        rows.append((k, text, "en", None, len(text or "")))
    rows += [rows[5], rows[5], rows[6], (None, say(60), "de", "s", 1), (None, rows[9][1], "de", "s", 1)]
    rows += [(None, None, None, None, None)] * 2
    where = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(where / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where)


def without(text, gone, pattern):
    """The text without words that are gone and what follows each up to the next word."""
    data = text.encode()
    starts = [m.start() for m in pattern.finditer(data)] + [len(data)]
    out = data[: starts[0]]
    for k, g in enumerate(gone):
        if not g:
            out += data[starts[k] : starts[k + 1]]
    return out.decode()


def plain_near(rows):
    """One row of each component of 5-word Jaccard links of 0.8 or more."""
    things = sorted({(r[0], r[1]) for r in rows}, key=key)
    sets = []
    for _, text in things:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    up = list(range(len(things)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(things)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[root(i)] = root(j)
    best = {}
    for k, (d, _) in enumerate(things):
        rank = (d is None, d or 0)
        if root(k) not in best or rank < best[root(k)][0]:
            best[root(k)] = (rank, k)
    return {things[k] for _, k in best.values()}


def plain_repeats(rows):
    every = [re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode()) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, every, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = True
        text = without(r[1], gone, re.compile(rb"[^\x20\x09-\x0D]+")) if gone.any() else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if gone.any() else r[4]))
    return out


def plain_clean(rows, items):
    cut = lambda t: ALNUM.findall((t or "").encode().translate(LOWER))
    windows = defaultdict(set)
    for _, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[len(w[k : k + 10])].add(tuple(w[k : k + 10]))
    out = []
    for r in rows:
        w = cut(r[1])
        gone = np.zeros(len(w), bool)
        for n, own in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in own:
                    gone[k : k + n] = True
        # Word starts don't change with case.
        text = without(r[1], gone, re.compile(ALNUM.pattern.replace(rb"\x3A-\x60", rb"\x3A-\x40\x5B-\x60"))) if gone.any() else r[1]
        out.append((r[0], text, r[2], r[3], len(text) if gone.any() else r[4]))
    return out


def test_clashing_names(spark, corpus):
    """Extra columns may have the names that operators work with."""
    import corpus_pipeline

    names = "_sd_spans _sd_rows _sd_k1 _dc_items _dc_hits _dc_n_words _nd_key _nd_rows _nd_row _toxicity spans rows id component_id other_1 n_words clean_text".split()
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id > 480 OR doc_id < 40 OR doc_id IS NULL")
    wide = docs.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        plain, kept = stage(spark, docs, corpus), stage(spark, wide, corpus)
        assert kept.columns == wide.columns, name
        assert sorted(map(tuple, kept.select(*docs.columns).collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
        assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for r in kept.collect() for n in names)


def test_pipeline_stages(spark, corpus):
    """Rows of each stage, each on what the one before kept; at the end they are those of run()."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from splatlake.llm.packing import tokenizer_path

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "packing"]
    rows = lambda t: sorted(map(tuple, t.collect()), key=key)
    model = toxicity.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    before, kept = rows(docs), stages["toxicity"](spark, docs, corpus)
    assert rows(kept) == [r for r in before if plain_score(r[1], model) < 0.5]
    toxic = [r for r in before if "vileword" in (r[1] or "")]
    assert len(toxic) > 90 and sum(r in set(rows(kept)) for r in toxic) < 10
    before, kept = rows(kept), stages["jaccard_join"](spark, kept, corpus)
    assert Counter((r[0], r[1]) for r in rows(kept)) == Counter(plain_near(before)) and set(rows(kept)) <= set(before) and len(before) > len(rows(kept)) + 8
    before, kept = rows(kept), stages["substring_dedup"](spark, kept, corpus)
    assert rows(kept) == sorted(plain_repeats(before), key=key) and sum(len(r[1] or "") for r in rows(kept)) < sum(len(r[1] or "") for r in before)
    before, kept = rows(kept), stages["decontamination"](spark, kept, corpus)
    items = [tuple(r) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    assert rows(kept) == sorted(plain_clean(before, items), key=key) and rows(kept) != before
    t, before, places = Tokenizer.from_file(tokenizer_path()), rows(kept), defaultdict(list)
    want = Counter()
    for r in before:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    packed = stages["packing"](spark, kept, corpus).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 4096
    whole = corpus_pipeline.run(spark, corpus).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == want and len({r.sequence_id for r in whole}) == len(places)
