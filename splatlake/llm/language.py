"""Language identification by compression with a raw-content zstandard dictionary for each language.

A text is cut into blocks of ``BLOCK`` bytes at character boundaries; each block is compressed with
every language's dictionary, and the language with the smallest total wins. The relative margin to the
runner-up gives the score; ``confident`` is false where the margin is narrow, which is the rejection.

Dictionaries are made of a bounded sample: of each language some ``SAMPLE_DOCS`` different labelled texts, one at least, taken by a
hash; of the ``PIECE``-byte pieces that these whole texts are cut into, ``PIECES`` by a hash again. With very many
languages each has fewer pieces, one at least, so that all dictionaries together hold ``TOTAL`` bytes;
more than ``TOTAL`` / ``PIECE`` languages are refused. Prediction reads whole texts in the tasks that scan
them, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, and all texts are if
nothing is labelled; of equal sizes the first language in order of its name wins, with score 0.5;
repeated rows get equal results and count once in what is learned; null languages, and those with blank texts only, are not learned; null ids are not held out; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatlake.llm.words import column, ranges_of

SAMPLE_DOCS = 400
PIECES, PIECE = 200, 512
BLOCK = 2048
TOTAL = 32 << 20
LEVEL = 6
#: Relative margin below which a prediction is rejected.
NARROW = 0.02

#: Letters, and other characters of words, such as numerals in circles.
_WORDLIKE = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, cut between characters."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            pieces = list(blocks(text.as_py().encode("utf-8", "replace"), PIECE))
            order = [zlib.crc32(p) for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(pieces), pa.string()), pa.array(pieces, pa.binary()), pa.array(order, pa.int64())], ["lang", "piece", "order"])


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionary of each language, from labelled documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", F.col("text").cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    known = known.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(1 << 30)))
    # Repeated texts count once; copies are joined in the tasks that read them.
    counts = {r["lang"]: (r["n"], r["first"]) for r in known.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first")).collect()}
    if len(counts) * PIECE > TOTAL:
        raise ValueError(f"{len(counts)} languages are more than dictionaries of {TOTAL} bytes have pieces for")
    if not counts:
        return {}
    # Each text is taken with a probability that gives the wanted number in the mean, so no task gathers a language; one is taken at least.
    share = docs.sparkSession.createDataFrame([(lang, max(first, int(min(1.0, per_language / n) * (1 << 30)))) for lang, (n, first) in counts.items()], "lang string, most long")
    chosen = known.join(F.broadcast(share), "lang").where("draw <= most").groupBy("lang", "draw").agg(F.min("text").alias("text")).select("lang", "text")
    each = min(PIECES, TOTAL // PIECE // len(counts))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "piece"))
    rows = chosen.mapInArrow(_cut, "lang string, piece binary, order long").withColumn("nth", nth).where(F.col("nth") <= each).collect()
    out = dict.fromkeys(sorted(counts), b"")
    for r in sorted(rows, key=lambda r: (r["lang"], r["nth"])):
        out[r["lang"]] += bytes(r["piece"]) + b"\n"
    return out


class Classifier:
    """Compressors of all languages; made once in each task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        self.names = sorted(dictionaries)
        self.compressors = []
        for name in self.names:
            d = zstd.ZstdCompressionDict(dictionaries[name], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, data: bytes) -> list[int]:
        total = [0] * len(self.names)
        for block in blocks(data):
            for k, compress in enumerate(self.compressors):
                total[k] += len(compress(block))
        return total

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not has_letter(text):
            return "und", 0.0, False
        data = text.encode("utf-8", "replace")
        sizes = self.sizes(data)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        second = min(s for k, s in enumerate(sizes) if k != best)
        margin = (second - sizes[best]) / max(1, second)
        return self.names[best], float(min(1.0, 0.5 + 2 * margin)) if margin else 0.5, margin >= NARROW


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and confident of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most some TOTAL bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            texts = column(batch, "text")
            found = [classifier.predict(t) for a, b in ranges_of(texts) for t in texts.slice(a, b - a).to_pylist()]
            lang, score, sure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "confident"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, confident boolean")
