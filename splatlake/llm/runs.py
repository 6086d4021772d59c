"""Runs (maximal repetitions) of the words of a document in linear time, from comparisons of words alone.

The first period of every run holds a Lyndon root: a word that is smaller than all its proper suffixes in
one of two opposite orders of the alphabet, and whose next root begins where the next smaller suffix does. So the
candidates are, in each order, the pairs (i, next smaller suffix of i), and a run is what a pair's matched words
to the right and to the left make of it.

* ``lyndon_pairs`` finds next and previous smaller suffixes from left to right with the length that each pair of
  suffixes has in common. Where the place at hand lies inside the last match that reached furthest, the pair
  was met before, one shift to the left, and its common length is taken from there; words are compared only from
  the furthest place reached on.
* ``left_reach`` extends pairs to the left, from the last pair to the first, and reuses earlier extensions in the same way.

No suffix array, tree or automaton is made, nothing is hashed or numbered: words are compared as they are,
by ``==`` and ``<``. A document is one task's work, in memory linear in its words (some 200 bytes each).

Defined results: a null or empty text has no words and no runs; repeated rows are judged one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 12
#: Bytes of collapsed texts that a task holds before it hands them on.
OUTPUT_BYTES = 1 << 23


def lyndon_pairs(words: Sequence, up: bool) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Pairs (i, j, common) of suffixes, j the next smaller one of i, with ``common`` > 0 equal words; and all j (len(words): none).

    ``up`` is the words' own order, else the opposite one. A suffix that begins another is the smaller of the two.
    """
    n = len(words)
    smaller_before, common_before = [-1] * n, [0] * n
    smaller_after, common_after = [n] * n, [0] * n
    pairs = []
    # The match that reached furthest: the words from ``begin`` up to ``far`` equal those ``shift`` before.
    far = begin = shift = 0
    for i in range(1, n):
        k, m = i - 1, 0  # the suffixes at k and i have m words in common, at least
        while k >= 0:
            if i + m < far and k >= begin:
                a, b = k - shift, i - shift
                if smaller_after[a] == b:
                    m = max(m, min(common_after[a], far - i))
                elif smaller_before[b] == a:
                    m = max(m, min(common_before[b], far - i))
            at, back = i + m, i - k
            while at < n and words[at] == words[at - back]:
                at += 1
            m = at - i
            if m and at >= far:
                far, begin, shift = at, i, back
            if at < n and (words[at - back] < words[at]) is up:
                smaller_before[i], common_before[i] = k, m
                break
            # The suffix at i is smaller than that at k, and than all before k that k has more in common with than with i.
            while True:
                smaller_after[k] = i
                if m:
                    common_after[k] = m
                    pairs.append((k, i, m))
                shared, k = common_before[k], smaller_before[k]
                if k < 0 or shared == m:
                    break
                if shared < m:
                    smaller_before[i], common_before[i], k = k, shared, -1
                    break
    return pairs, smaller_after


def left_reach(words: Sequence, pairs: list[tuple[int, int, int]], smaller_after: list[int], shortest: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs whose first Lyndon roots are among the pairs.

    A pair that is extended by a whole period isn't its run's first one, and is left to that. Pairs that no
    extension of less than a period makes long enough are passed over.
    """
    reach: dict[int, int] = {}
    # The words from ``low`` up to ``end`` equal those ``shift`` after.
    low = end = len(words)
    shift = 0
    for i, j, m in sorted(pairs, reverse=True):
        period = j - i
        if 2 * period + m <= shortest:
            continue
        e = 0
        if low < i and j <= end and smaller_after[i + shift] == j + shift:
            e = min(reach.get(i + shift, 0), i - low)
        while e < period and e < i and words[i - 1 - e] == words[j - 1 - e]:
            e += 1
        reach[i] = e
        if e and i - e <= low:
            low, end, shift = i - e, i, period
        if e < period and e + period + m >= max(shortest, 2 * period):
            yield i - e, e + period + m, period


def find_runs(words: Sequence, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal stretches of smallest period p and length of at least ``shortest`` and 2 p, in order."""
    found = []
    for up in (True, False):
        found += left_reach(words, *lyndon_pairs(words, up), shortest)
    found.sort()
    return [r for k, r in enumerate(found) if not k or r != found[k - 1]]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    kept, at = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        if end > at:
            kept += words[at : max(at, begin)]
            at = end
    return b" ".join(kept + words[at:] if runs else words)


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and then period) and collapsed text of each row of docs (doc_id, text).

    Words are maximal runs of bytes other than ASCII white space. Rows stay where they are: nothing is shuffled.
    """
    of_run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def table(ids: pa.Array, at: int, rows: list[tuple]) -> pa.RecordBatch:
        counts, runs, texts = zip(*rows, strict=True)
        lists = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        arrays = [ids.slice(at, len(rows)), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(of_run)), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, at, size = [], 0, 0
            for text in texts:
                words = (text.as_py() or b"").split()
                runs = find_runs(words, shortest)
                rows.append((len(words), runs, collapsed(words, runs)))
                size += len(rows[-1][-1])
                if size > OUTPUT_BYTES:
                    yield table(ids, at, rows)
                    rows, at, size = [], at + len(rows), 0
            if rows:
                yield table(ids, at, rows)

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(found, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, each tenth document (by a checksum of its id) made periodic from some word on; rows without an id stay as they are.

    With h the checksum, g a tenth of it and n words, word i from a = g mod n on becomes word
    a + (i - a) mod p, where p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("words", words).withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words").cast("long")})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
