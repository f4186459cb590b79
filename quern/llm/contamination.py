"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct word shingles, up to 2, 4, 8, ... For containment t, an
item of q shingles can miss at most floor((1 - t) * q) of them in a document that contains it. So the
bottom-k MinHash sketch of an item with k = floor((1 - t) * upper size of its partition) + 1 always
keeps a shingle that such a document has: probing the shingles of a document, however long, against the
sketches finds every containing document, short items in long documents included. Candidates are
verified on all shingle hashes and then on the shingles' words.

Documents are never shuffled. The items are a stated query set; they are sent to the executors in
blocks of at most about ``block_bytes`` of text, one pass over the documents for each block. The driver holds one
block at a time: what a pass found is written before the next block is built. Items that repeat travel once.

Words are split at white space, lower-cased in A-Z, and bare of ASCII punctuation at their ends; words
of nothing else are skipped. Defined cases: null, empty and wordless texts contain nothing and items
without words are in nothing; items of fewer words than a shingle are one shingle of that length; null
ids are returned as they are; repeated documents and items each give rows of their own; empty tables
give no rows; ``clean`` carries all columns whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, written
from quern.llm.hashing import mixed

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_BYTES = 8 << 20
MARKS = punctuation.encode()
#: Distinct words whose hashes a worker remembers at a time; it forgets all of them beyond.
REMEMBER = 400_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Raw word -> hash of its bare form, 0 for none."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        bare = word.lower().strip(MARKS)
        self[word] = out = (xxh64_intdigest(bare) or 1) if bare else 0
        return out


def bare_words(text: bytes) -> list[bytes]:
    return [y for x in text.split() if (y := x.lower().strip(MARKS))]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles; empty if there are fewer words."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mixed(out * STEP + words[i : len(words) - n + 1 + i])
    return out


@dataclass
class Sketches:
    """The items of one block, by shingle length."""

    threshold: float
    ids: list = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    index: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple], threshold: float, shingle: int) -> Sketches:
        self, keys, known = cls(threshold), defaultdict(lambda: defaultdict(list)), WordHashes()
        for item_id, text, copies in items:
            if not (words := bare_words(text or b"")):
                continue
            n = min(shingle, len(words))
            own = np.unique(gram_hashes(np.array([known[w] for w in words], dtype=np.uint64), n))
            upper = 1 << max(0, math.ceil(math.log2(len(own))))  # of its size partition
            k = math.floor((1 - threshold) * upper + 1e-9) + 1
            for h in own[:k].tolist():  # the least k hashes
                keys[n][h].append(len(self.ids))
            self.ids.append(item_id)
            self.copies.append(copies)
            self.words.append(words)
            self.hashes.append(own)
        self.index = {n: (np.array(sorted(d), dtype=np.uint64), dict(d)) for n, d in keys.items()}
        return self

    def within(self, text: bytes, known: WordHashes) -> Iterator[tuple[int, int, int]]:
        """(item's place, its distinct shingles, those that the text has) for each item that it contains."""
        if len(known) > REMEMBER:
            known.clear()
        raw = text.split()
        codes = np.fromiter(map(known.__getitem__, raw), dtype=np.uint64, count=len(raw))
        codes = codes[codes != 0]
        for n, (probe, where) in self.index.items():
            grams = gram_hashes(codes, n)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(probe, grams), len(probe) - 1)
            hit = np.unique(grams[probe[at] == grams])
            candidates = sorted({i for h in hit.tolist() for i in where[h]})
            if not candidates:
                continue
            there, words, shingles = np.unique(grams), None, None
            for i in candidates:
                q = len(self.hashes[i])
                if np.isin(self.hashes[i], there, assume_unique=True).sum() < self.threshold * q - 1e-9:
                    continue
                if shingles is None:
                    words = bare_words(text)
                    shingles = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
                own = {tuple(self.words[i][j : j + n]) for j in range(len(self.words[i]) - n + 1)}
                if (shared := len(own & shingles)) >= self.threshold * len(own) - 1e-9:
                    yield i, len(own), shared


def _blocks(items: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, block_bytes: int) -> Iterator[tuple[Sketches, bool]]:
    """The sketches of each block, and whether it is the last."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()  # about block_bytes
        yield Sketches.of(sorted(((r[0], bytes(r[1] or b""), r[2]) for r in own), key=str), threshold, shingle), k == n - 1


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc id, item id, item_shingles, shared_shingles, containment) for every document that contains an item."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    kinds = rows.schema[0].dataType, items.schema[item_col].dataType
    schema = f"`{id_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, item_shingles bigint, shared_shingles bigint, containment double"
    for sketches, last in _blocks(items, item_col, item_text, threshold, shingle, block_bytes):
        sent = spark.sparkContext.broadcast(sketches)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, known = sent.value, WordHashes()
            for b in batches:
                hits = [(row, *x) for row, t in enumerate(b.column(1)) for x in own.within(t.as_py() or b"", known) for _ in range(own.copies[x[0]])]
                if hits:
                    row, item, q, shared = zip(*hits, strict=True)
                    ids = pa.array([own.ids[i] for i in item], type=_arrow(kinds[1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), ids, pa.array(q, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / x for s, x in zip(shared, q, strict=True)], pa.float64())], names=["d", "i", "q", "s", "c"])

        part = rows.mapInArrow(run, schema)
        if not last:
            part = written(part)
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that contain no item."""
    spark, before = docs.sparkSession, None
    for sketches, last in _blocks(items, item_col, item_text, threshold, shingle, block_bytes):
        sent = spark.sparkContext.broadcast(sketches)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, known = sent.value, WordHashes()
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col))
                stay = [next(own.within((t.as_py() or "").encode(), known), None) is None for t in texts]
                yield b.filter(pa.array(stay, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = written(docs)
            sent.destroy()
            if before is not None:
                forget(before)
            before = docs
    return docs
