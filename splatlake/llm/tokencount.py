"""Token counts of whole texts by a byte-level BPE tokenizer, from the lengths of pre-tokens.

The tokenizer parts a text into pre-tokens (a word with the blank before it, a run of digits, of marks or of white space)
and encodes each by itself, so a text's count is the sum over its pre-tokens. Lengths are looked up in two tiers:

1. a table of the corpus's most frequent pre-tokens, at most ``FREQUENT`` of up to ``LONGEST`` characters (under 9 MB
   whatever the corpus), broadcast to all workers;
2. a cache in each Python worker of what the table lacks, filled by the tokenizer's model.

Frequencies are counted over all texts; each task keeps its most frequent pre-tokens only, and these summaries are
merged in a tree. Pre-tokens are never shuffled, and the table decides nothing but where a length is found.

Defined results: a null or empty text has no bytes and no tokens; a special token's string in a text is one token, as the
library has it; repeated rows are counted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatlake.llm.packing import STAND_INS, tokenizer_path
from splatlake.llm.tree import tree_reduced

LIMIT = 512
#: Pre-tokens in the table, and characters of the longest that it takes.
FREQUENT, LONGEST = 1 << 15, 64
#: Pre-tokens in a worker's cache, and those a task counts before it forgets the rarest.
CACHED, COUNTED = 400_000, 8 * FREQUENT
#: Pre-tokens of a text that are looked up at once.
SLICE = 100_000
# The tokenizer's stages before its model, and what these part texts by.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pre_tokens(text: str) -> Iterator[list[str]]:
    """Pre-tokens of a text in slices."""
    if len(text) <= SLICE:
        yield _pattern().findall(text)
        return
    found = (m.group() for m in _pattern().finditer(text))
    while some := list(itertools.islice(found, SLICE)):
        yield some


@functools.cache
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


class _Cache(dict):
    """Lengths of pre-tokens that the broadcast table lacks."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, pre_token: str) -> int:
        n = len(self.model.tokenize(pre_token.encode().decode("latin-1").translate(STAND_INS)))
        if len(pre_token) <= LONGEST:
            self[pre_token] = n
        return n

    def trim(self) -> None:
        if len(self) > CACHED:  # what came first is mostly what is frequent
            for k in list(itertools.islice(self, CACHED // 2, None)):
                del self[k]


class TokenCounter:
    """Number of tokens of whole texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` has it.

    Texts are parted here only if the tokenizer's stages are those of ``PRE_TOKENIZER``, and only where each of a text's characters
    has been seen to be parted alike by the library; all other texts are encoded by the library as they are.
    """

    def __init__(self, path: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), table
        with open(path, encoding="utf-8") as f:
            stages = json.load(f)
        added = stages.get("added_tokens") or []
        plain = all(a["special"] and not (a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"]) for a in added)
        model = stages["model"]
        own = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.by_pre_tokens = plain and own and stages.get("pre_tokenizer") == PRE_TOKENIZER and not any(stages.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in added)) if added else None
        self.names = [a["content"] for a in added]
        self.cache = _Cache(self.tokenizer.model)
        self.alike: set[str] = set()
        self.unlike: set[str] = set()

    def __call__(self, text: str) -> int:
        if not self.by_pre_tokens or not self._known(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if any(name in text for name in self.names):
            return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        total, length = 0, self.table.get
        for found in pre_tokens(text):
            lengths = list(map(length, found))
            total += sum(filter(None, lengths))
            total += sum(map(self.cache.__getitem__, [p for p, n in zip(found, lengths, strict=True) if n is None]))
            self.cache.trim()
        return total

    def _known(self, text: str) -> bool:
        """Whether the library's classes of all characters are known to be those of ``PATTERN`` here."""
        if self.alike.issuperset(text):
            return True
        for c in set(text) - self.alike - self.unlike:
            sample = f"a{c}a {c}1{c} {c}{c}.{c}."
            parts = [sample[b:e] for _, (b, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(sample)]
            (self.alike if parts == _pattern().findall(sample) else self.unlike).add(c)
        return self.unlike.isdisjoint(text)


def _most(counts: Counter, n: int) -> Counter:
    """The n most frequent; ties to what sorts first."""
    if len(counts) <= n:
        return counts
    return Counter(dict(heapq.nsmallest(n, counts.items(), key=lambda kv: (-kv[1], kv[0]))))


def frequent_pre_tokens(docs: DataFrame, n: int = FREQUENT) -> list[str]:
    """Most frequent pre-tokens of all texts by the counts that tasks keep (a task forgets what is rare in it).

    The driver sees at most some thirty summaries of n pre-tokens.
    """

    def summary(batches: Iterator[pa.RecordBatch]) -> Counter:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for found in pre_tokens(text.as_py() or ""):
                    counts.update(found)
                    if len(counts) > COUNTED:
                        counts = _most(counts, COUNTED // 2)
        return _most(Counter({k: v for k, v in counts.items() if len(k) <= LONGEST}), n)

    found = tree_reduced(docs.select(F.col("text").cast("string")), summary, lambda a, b: _most(a + b, n), Counter())
    return sorted(found)


def length_table(pre_tokens: list[str], path: str) -> tuple[list[str], bytes]:
    """Pre-tokens with their numbers of tokens, a byte each (a pre-token of ``LONGEST`` characters has at most four times as many bytes, 256; longer counts are left out)."""
    cache = _Cache(TokenCounter(path, {}).tokenizer.model)
    rows = [(p, cache[p]) for p in pre_tokens]
    rows = [(p, n) for p, n in rows if n < 256]
    return [p for p, _ in rows], np.asarray([n for _, n in rows], np.uint8).tobytes()


_COUNTERS: dict[str, TokenCounter] = {}


def _counter(path: str, name: str, table: Broadcast) -> TokenCounter:
    """One for all tasks of a worker that read the same broadcast."""
    if name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[name] = TokenCounter(path, dict(zip(*table.value, strict=True)))
    return _COUNTERS[name]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each row of docs (doc_id, text).

    ``path`` is a tokenizer's file that all executors can open.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    table = docs.sparkSession.sparkContext.broadcast(length_table(frequent_pre_tokens(docs), path))

    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, name, table)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes, tokens = [], []
            for text in texts.cast(pa.binary()):
                raw = text.as_py() or b""
                sizes.append(len(raw))
                tokens.append(counter(raw.decode()))
            n = np.asarray(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, schema)
