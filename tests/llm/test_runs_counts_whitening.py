"""Periodic runs, token counts and whitening against plain versions; long texts, repeated rows and odd pages of the other operators."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("splatlake.llm")
from splatlake.llm import language, toxicity, warc  # noqa: E402
from splatlake.llm import queries as Q  # noqa: E402
from splatlake.llm.packing import tokenizer_path  # noqa: E402
from splatlake.llm.runs import find_runs, periodic_runs, planted  # noqa: E402
from splatlake.llm.tokencount import TokenCounter, count_tokens  # noqa: E402
from splatlake.llm.whitening import Moments, whiten  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def plain_runs(w, shortest):
    """All stretches by their definition: for each period the maximal ones, without those of a smaller period."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        same = [w[i] == w[i + p] for i in range(n - p)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            if not s and start is not None:
                length, seg = i + p - start, w[start : i + p]
                if length >= max(shortest, 2 * p) and not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.add((start, length, p))
                start = None
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 20), st.integers(0, 39), st.sampled_from([2, 5, 12]))
def test_runs_by_definition(words, period, begin, shortest):
    made = [w if i < begin else words[begin + (i - begin) % period] if begin + (i - begin) % period < len(words) else w for i, w in enumerate(words)]
    for w in (words, made):
        assert find_runs(w, shortest) == plain_runs(w, shortest)


class Counted:
    """A letter of an ordered alphabet that counts its comparisons; it has no hash."""

    __hash__ = None
    seen = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.seen += 1
        return self.v == other.v

    def __lt__(self, other):
        Counted.seen += 1
        return self.v < other.v


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def doubled(n):
    s = "ab"
    while len(s) < n:
        s += s + chr(97 + len(s) % 23)
    return s[:n]


@pytest.mark.parametrize("make", [fibonacci, doubled, lambda n: "a" * n, lambda n: [bin(i).count("1") & 1 for i in range(n)], lambda n: [random.Random(1).randrange(2) for _ in range(n // 8)] * 8, lambda n: list(range(n, 0, -1)), lambda n: [x for k in range(math.isqrt(2 * n)) for x in "b" + "a" * k], lambda n: ("a" * (n // 4) + "b") * 4])
def test_runs_take_linear_many_comparisons(make):
    for n in (2000, 16000):
        words = [Counted(v) for v in make(n)]
        Counted.seen = 0
        find_runs(words, 2)
        assert Counted.seen <= 13 * len(words)


def plain_op11(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), s, length, q, 1000 * length // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), len(words))


def digests(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect()]


def by_repr(rows):
    return sorted(rows, key=repr)


def test_op11_by_definition(spark, tmp_path):
    rng = random.Random(5)
    texts = ["", None, " \t", "a", "one", "x " * 11, "x " * 12, "a b " * 200, "  " * 14, "nul\0 " * 12, "y " + "a b c " * 6 + "d " + "a b c " * 6, "w\v" * 7 + "w\f" * 7]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(150))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "q " * 20), (None, None), (7, "a b " * 200), (7, "a b " * 200)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5
    docs = spark.createDataFrame([(*r, "other") for r in rows], DOC + ", runs string")
    assert by_repr(digests(spark, docs, tmp_path)) == by_repr([plain_op11(*r) for r in rows])


def test_op11_on_the_smallest_table(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len((r[1] or "").split()) < 700}
    rows = {r[0]: tuple(r) for r in Q.op11_periodic_runs(spark, SF).collect()}
    assert all(rows[d] == plain_op11(d, t) for d, t in docs.items()) and len(docs) > 100


def test_runs_of_empty_table_and_long_text(spark):
    assert periodic_runs(spark.createDataFrame([], DOC)).count() == 0
    assert planted(spark.createDataFrame([], DOC)).count() == 0
    text = "a b c " * 300_000
    row = periodic_runs(spark.createDataFrame([(1, text)], DOC)).head()
    assert [tuple(r) for r in row["runs"]] == [(0, 900_000, 3)] and row["collapsed"] == "a b c"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


ODD = ["", " ", "  ", "\n\n x", "it's they'll 'S ''s", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> ", "<|endoftext|", "x\u0085y z  　", "\x1c a\x1d\x1e\x1f", "՘֋ a౜b", "\U00010940\U00016d40", "é İ ﬁ Ⅰ ²", "你好 \U0001f600\U0001f3fb", "\0\0a", "-" * 300, "1234567890" * 9, " \t \t x \t", "ABC" * 5000, "ẞꟜ꟱"]


def test_counter_is_the_library(spark):
    lib, counter = library(), TokenCounter(tokenizer_path("byte_bpe_50k.json"), {" the": 1})
    rng = random.Random(3)
    alphabet = "aZéΩЖ \n\t '.,!<|>12٠中\U0001f600́ßꟜ"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert [counter(t) for t in texts] == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.unlike and counter.cache


def test_token_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a b", ""), (5, None, None), (5, None, None), (6, "word " * 300_000, "")]
    docs = spark.createDataFrame(rows, DOC + ", n_tokens string")
    lib = library()
    want = [(d, len((t or "").encode()), k := len(lib.encode(t or "", add_special_tokens=False).ids), k > 512) for d, t, _ in rows]
    assert by_repr(map(tuple, count_tokens(docs.repartition(5)).collect())) == by_repr(want)
    assert count_tokens(docs.limit(0)).count() == 0


def test_other_tokenizers_get_whole_texts(spark):
    path = tokenizer_path("word_bpe_49k.json")
    counter = TokenCounter(path, {})
    assert not counter.by_pre_tokens
    docs = spark.createDataFrame([(1, "It's a Test, a test")], DOC)
    assert count_tokens(docs, path).head()["n_tokens"] == len(counter.tokenizer.encode("It's a Test, a test", add_special_tokens=False).ids)


def test_token_counts_of_the_smallest_table(spark):
    lib = library()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, len((t or "").encode()), k := len(lib.encode(t or "", add_special_tokens=False).ids), k > 512) for d, t in docs]
    assert by_repr(map(tuple, Q.op12_token_counts(spark, SF).collect())) == by_repr(want)


def test_chan_merging():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 61), 1 << 61, (300, 5))
    parts = [Moments.of(p) for p in np.array_split(x, [1, 7, 200])]
    m = (parts[0] + parts[1]) + (Moments() + (parts[2] + parts[3]))
    assert m.n == 300 and m.sums == [sum(map(int, c)) for c in x.T]
    assert np.allclose(m.scatter / m.n, np.cov(x.T.astype(float), bias=True), rtol=1e-12)


def plain_whitening(rows, k=8):
    """Deviations in whole numbers; whitened values up to the sign of each component."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    d = n * x - s
    centred = d.astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    with np.errstate(invalid="ignore", divide="ignore"):
        white = centred @ basis / np.sqrt(values)
    return {(i, c + 1): (n, int((d[r] ** 2).sum()), white[r, c], values[c] / values.sum()) for r, (i, _) in enumerate(good) for c in range(min(k, x.shape[1]))}


def agrees(found, want):
    assert len(found) == len(want)
    sign = {}
    for r in found:
        n, deviation, white, part = want[r[0], r[1]]
        assert (r[2], int(r[3])) == (n, deviation) and abs(r[5] - part) < 1e-9 and r[6] < 1e-4
        if abs(white) > 1e-3:
            assert sign.setdefault(r[1], r[4] * white > 0) == (r[4] * white > 0)
        assert abs(abs(r[4]) - abs(white)) < 1e-6


def test_op13_by_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    agrees(Q.op13_embedding_whitening(spark, SF).collect(), plain_whitening(rows))


def test_whitening_leaves_out_what_is_no_vector(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(3, 10**-k) for k in range(4)]) for i in range(200)]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, math.nan, 2.0, 3.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [1e300, 0.0, 0.0, 0.0])]
    odd += [(906, [1.0, 2.0])] * 5
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "vec_id long, embedding array<double>, whitened double").repartition(7)
    agrees(whiten(docs).collect(), plain_whitening(rows))
    far = [(i, [v * 1e12 for v in r]) for i, r in rows]  # deviations beyond 64 bits
    agrees(whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect(), plain_whitening(far))


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], kind)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], kind)).count() == 0
    same = whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 3 + [(None, [0.5, 1.0])], kind)).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], kind)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in line) and len(line) == 150


def test_one_insult_in_very_long_texts(spark):
    rng = random.Random(4)
    plain = [f"w{rng.randrange(4000)}" for _ in range(3000)]

    def say(size, bad):
        w = [rng.choice(plain) for _ in range(size // 6)]
        if bad:
            w.insert(rng.randrange(len(w)), "vileword nastyone horridly")
        return " ".join(w)

    docs = spark.createDataFrame([(k, say(300_000, k % 2)) for k in range(120)], DOC).repartition(8)
    model = toxicity.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, toxic int"))
    p = model.scores([say(300_000, k % 2) for k in range(20)]) >= 0.5
    assert p[1::2].mean() > 0.9 and p[::2].mean() < 0.1


def test_samples_at_hand_and_shared_agree(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 60))) + (" awfulthing" if k % 4 == 0 else "") for k in range(200)]
    toxic, fold = [int(k % 4 == 0) for k in range(200)], [k % toxicity.FOLDS for k in range(200)]
    local = toxicity.LocalSample(texts, toxic, fold)
    shared = toxicity.SharedSample(spark.createDataFrame(list(zip(toxic, fold, texts, strict=True)), "toxic int, fold int, text string").repartition(3))
    a, b = toxicity.trained(local, 50, 200), toxicity.trained(shared, 50, 200)
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias
    assert ((a.scores(texts) >= 0.5) == np.array(toxic, bool)).mean() > 0.97


def test_slices_of_long_texts():
    text = "one two three " * 30_000
    parts = [p for _, part in toxicity.units(["a b", text, "", "c" * 300_000]) for p in part]
    assert "".join(parts) == "a b" + text + "c" * 300_000 and max(map(len, parts)) <= toxicity.SLICE_BYTES


def test_language_of_repeated_rows(spark):
    rows = [(k, "ceci est un texte que l'on répète, et rien de plus, encore et encore", "fr") for k in range(2000)]
    rows += [(3000 + k, f"this is text number {k} of those that are not the same, said in some other way {k * 7}", "en") for k in range(600)]
    rows += [(9000 + k, " ", "xx") for k in range(9)] + [(None, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.fit(docs)
    assert set(found) == {"en", "fr"} and found["fr"].startswith(b"ceci est")
    ask = spark.createDataFrame([(1, "un texte que l'on répète"), (2, "those that are not the same")], DOC)
    assert [r["lang_pred"] for r in language.predict(ask, found).orderBy("doc_id").collect()] == ["fr", "en"]


def test_links_and_titles_in_linear_time():
    import time

    for piece in ("<img src", "<a ", "<title>", "<a href='", '<a "', "<a x", "<title ", "<a href=a ", "a=" + " " * 50):
        page = piece * (1_000_000 // len(piece))
        start = time.time()
        warc.page_links(page), warc.page_title(page)
        assert time.time() - start < 2, piece
    page = "<TITLE lang=en> A &amp;\n b</Title><a class='x>y' HREF=\"/p?a=1&amp;b=2\">t</a><img alt src=i.png><script>1</script><form action=''><a name=q><iframe data-src=no src='f'>"
    assert warc.page_title(page) == "A & b" and warc.page_title("<title>open") == ""
    assert [(v["path"], v["url"]) for v in warc.page_links(page)] == [("a@/href", "/p?a=1&b=2"), ("img@/src", "i.png"), ("form@/action", ""), ("iframe@/src", "f")]


def test_links_and_heads_inside_articles():
    from splatlake.llm import htmltext

    a, b = "The committee met on Tuesday to discuss the new plan for the harbour.", "Several members asked for more time before the vote was held in the hall."
    page = "<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>{}<footer><p>&copy; 2024 Site</p></footer></body></html>"
    model = htmltext.default_model()
    cases = {
        f"<article><h1>Harbour plan</h1><p>They met; <a href=/x>the earlier report</a> says.</p><p>{b}</p></article>": ["Harbour plan", "They met; the earlier report says.", b],
        f"<article><p>{a}</p></article>": [a],
        f"<main><div class=row><div class=col>{a}</div><div class=col>{b}</div></div></main>": [a, b],
        f"<article><h1>T</h1><p>{a}</p><table><tr><th>Name</th><th>Age</th></tr><tr><td>Bo</td><td>7</td></tr></table><p>{b}</p></article>": ["T", a, "Name", "Age", "Bo", "7", b],
    }
    assert htmltext.main_texts([page.format(c) for c in cases], model) == ["\n\n".join(v) for v in cases.values()]
