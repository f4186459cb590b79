"""Repeated word spans by compaction of a token De Bruijn graph.

Edges are windows of WIDTH words, nodes the WIDTH - 1 words that consecutive edges share. The graph is that
of the repeated edges, those found at two coordinates or more; each knows the least coordinate at which it
is found. A coordinate is (document, start), documents in order of (id, hash of the text).

1. ``super_kmers``: consecutive windows that share their minimizer, a gram of GRAM words, are one row, as in
   the published partitioned constructions of De Bruijn graphs. A minimizer met at one place has no repeated
   edge. Super-k-mers of equal words are a class, so that copies don't multiply edges.
2. ``edges``: one super-k-mer of each class is opened into its edges; if its minimizer has no other class, its
   windows are alike everywhere and it stays one edge of n windows, compacted where it stands. Spark counts
   edges, keeps the repeated ones with their least coordinates, and counts the edges at each node.
3. ``compacted``: an edge continues another over a node with one edge in and one out, if its least coordinate
   is the next one. Such nonbranching paths are compacted: first in blocks of BLOCK starts, then by pointer
   jumping, a join per round, in as many rounds as the logarithm of the longest path. A path is a unit of
   work only: each edge keeps its own coordinate, so results don't depend on where paths end.
4. ``repeats``: the classes' edges meet the paths again, and each stretch of a class that runs along a path is
   a span with a source coordinate. A class's members get its spans; a span that isn't its own source goes.

Equality is decided by digests of 128 bits over the words at both coordinates, never by the rolling hashes
that find minimizers and nodes: edges of one digest are one edge, classes too.

Defined cases: null and blank texts have no words; documents shorter than a window lose nothing; ids may be
of any type, null ids come before all others; rows that share an id and have different texts are documents of
their own, ordered by the texts' hash, and rows that repeat both count as one document and get equal results;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import forget, written
from quern.llm.hashing import Prefix, digests, minimizer_runs

WIDTH, GRAM, BLOCK, SLICES = 20, 8, 64, 2
#: Bytes of text that a worker holds as words at a time, if one text isn't longer.
AT_ONCE = 1 << 20
#: The bytes that separate words.
BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


class Words:
    """The words of a batch of texts end to end: the bytes they join to, where each word and text ends, and hashes to look with."""

    def __init__(self, texts: pa.Array):
        each = texts.fill_null(b"").to_pylist()
        data = np.frombuffer(b" ".join([*each, b""]), dtype=np.uint8)  # a blank follows each text
        inside = ~BLANK[data]
        after = np.zeros_like(inside)
        after[1:] = inside[:-1]
        starts, stops = np.flatnonzero(inside & ~after), np.flatnonzero(after & ~inside)
        self.ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, each), dtype=np.int64, count=len(each)) + 1))
        self.sizes = np.diff(self.ends, prepend=0)
        self.at = np.zeros(len(starts) + 1, dtype=np.int64)  # where each word begins
        np.cumsum(stops - starts + 1, out=self.at[1:])
        joined = np.where(inside, data, np.uint8(ord(" ")))[inside | after]
        self.joined = joined.tobytes()
        self.hashes = np.empty(len(starts), dtype=np.uint64)
        low = 0
        while low < len(starts):  # about AT_ONCE bytes at a time, one word at least
            high = max(low + 1, int(np.searchsorted(self.at, self.at[low] + AT_ONCE, side="right")) - 1)
            at = self.at[low : high + 1] - self.at[low]
            self.hashes[low:high] = Prefix(joined[self.at[low] : self.at[high]]).of(at[:-1], at[1:] - 1)
            low = high

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return digests(self.joined, self.at[start].tolist(), (self.at[end] - 1).tolist())


def portions(b: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about AT_ONCE bytes of text."""
    part = np.cumsum(b.column(texts).fill_null(b"").to_pandas().str.len().to_numpy(dtype=np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)]
    for low, high in zip(cuts, cuts[1:]):
        if low < high:
            yield b.slice(low, high - low)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names.split())


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text): doc is (id, tie); tie tells texts of one id apart."""
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie")).alias("doc"), F.col(text_col).cast("binary").alias("text"))


def super_kmers(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(doc, start, n, key, d1, d2): runs of n windows with one minimizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in portions(whole, 1)):
            words = Words(b.column(1))
            for start, n, _, key in minimizer_runs(words.hashes, words.ends, width, gram):
                doc = np.searchsorted(words.ends, start, side="right")
                d = words.digests(start, start + n - 1 + width)
                yield _batch("doc start n key d1 d2", b.column(0).take(pa.array(doc)), (start - (words.ends - words.sizes)[doc]).astype(np.int32), n.astype(np.int32), key.view(np.int64), d[:, 0], d[:, 1])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, start int, n int, key bigint, d1 bigint, d2 bigint")


def opened(rows: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """The edges of the chosen super-k-mers (doc, start, n, copies, whole): (doc, run, start, n, copies, e1, e2, left, right); one of all windows if whole."""
    wanted = chosen.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "copies", "whole")).alias("runs"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in portions(whole, 1)):
            words = Words(b.column(1))
            many, mine = b.column(2).value_lengths().to_numpy(), b.column(2).flatten()
            first, n, copies, whole = (mine.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            edges = np.where(whole, 1, n)
            which = np.repeat(np.arange(len(mine)), edges)
            doc = np.repeat(np.arange(len(b)), many)[which]
            start = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(edges) - edges, edges)
            size = np.where(whole, n, 1)[which]
            at = (words.ends - words.sizes)[doc] + start
            hashed = Prefix(words.hashes)
            for low in range(0, len(at), 1 << 16):
                own = slice(low, low + (1 << 16))
                a, end = at[own], at[own] + size[own] - 1 + width
                d = words.digests(a, end)
                yield _batch("doc run start n copies e1 e2 left right", b.column(0).take(pa.array(doc[own])), first[which[own]].astype(np.int32), start[own].astype(np.int32), size[own].astype(np.int32), copies[which[own]], d[:, 0], d[:, 1], hashed.of(a, a + width - 1).view(np.int64), hashed.of(end - width + 1, end).view(np.int64))

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.join(wanted, "doc").mapInArrow(run, f"doc {kind}, run int, start int, n int, copies boolean, e1 bigint, e2 bigint, left bigint, right bigint")


def edges(all_edges: DataFrame) -> DataFrame:
    """The repeated edges: (e1, e2, doc, start, n, left, right) with doc and start of the least coordinate."""
    place = F.struct("doc", "start")
    counted = all_edges.groupBy("e1", "e2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("copies").alias("copies"), F.max("n").alias("n"), F.max("left").alias("left"), F.max("right").alias("right"))
    return counted.where("copies or first <> last").select("e1", "e2", "first.doc", "first.start", "n", "left", "right")


def compacted(graph: DataFrame, block: int = BLOCK) -> DataFrame:
    """(e1, e2, doc, root, off): each edge's place on its path; the path's first edge has the coordinate (doc, root)."""
    ends = graph.select(F.col("left").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(graph.select(F.col("right").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    plain = ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 and o = 1").select(F.col("node").alias("right"), F.lit(True).alias("through"))
    marked = graph.join(plain, "right", "left").select("e1", "e2", "doc", "start", "n", F.coalesce("through", F.lit(False)).alias("through"))
    own = Window.partitionBy("doc", F.floor(F.col("start") / block)).orderBy("start")  # at most ``block`` rows
    goes_on = (F.lag(F.col("start") + F.col("n")).over(own) == F.col("start")) & F.lag("through").over(own)
    marked = marked.withColumn("head", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("start")))
    marked = written(marked.withColumn("piece", F.last("head", ignorenulls=True).over(own)).drop("head"))
    pieces = marked.groupBy("doc", "piece").agg(F.sum("n").cast("int").alias("n"), F.max(F.struct("start", "through")).alias("tail"))
    before = pieces.where("tail.through").select("doc", (F.col("piece") + F.col("n")).alias("piece"), F.col("piece").alias("root"))
    now = written(pieces.select("doc", "piece").join(before, ["doc", "piece"], "left").select("doc", "piece", F.coalesce("root", "piece").alias("root")))
    while True:  # each round doubles the pieces that a pointer jumps over
        far = now.where("root <> piece").select("doc", F.col("piece").alias("root"), F.col("root").alias("up"))
        after = written(now.join(far, ["doc", "root"], "left").select("doc", "piece", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        forget(now)
        now = after
        if after.where("moved").isEmpty():
            break
    out = written(marked.join(now.drop("moved"), ["doc", "piece"]).select("e1", "e2", "doc", "root", (F.col("start") - F.col("root")).alias("off")))
    forget(marked, now)
    return out


def removed(rows: DataFrame, width: int, gram: int, slices: int = SLICES) -> DataFrame:
    """(doc, start, n): windows of each document that are found at an earlier coordinate. rows: from keyed()."""
    runs = written(super_kmers(rows, width, gram))
    met = None
    for s in range(slices):  # of the minimizers, one after another: it divides the disk that the join needs
        own = runs.where(F.pmod("key", F.lit(slices)) == s)
        keys = own.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
        part = written(own.join(keys, "key"))
        met = part if met is None else met.unionByName(part)
    forget(runs)
    at = F.struct("doc", "start")
    classes = written(met.groupBy("key", "d1", "d2", "n").agg(F.min(at).alias("one"), F.max(at).alias("last")).select("key", "d1", "d2", "one.*", "n", F.expr("one <> last").alias("copies")))
    alone = classes.groupBy("key").agg((F.min("d1") == F.max("d1")).alias("same1"), (F.min("d2") == F.max("d2")).alias("same2")).select("key", F.expr("same1 and same2").alias("whole"))
    chosen = classes.join(alone, "key").where("copies or not whole")
    every = written(opened(rows, chosen.select("doc", "start", "n", "copies", "whole"), width))
    graph = written(edges(every))
    paths = compacted(graph)
    forget(graph)
    along = every.select("doc", "run", "start", "n", "e1", "e2").join(paths.withColumnRenamed("doc", "source"), ["e1", "e2"])
    # the edges of a class that run along one path, shifted equally, are consecutive: between two of them all words agree
    spans = along.groupBy("doc", "run", "source", "root", (F.col("off") - F.col("start")).alias("shift")).agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"))
    spans = spans.groupBy("doc", "run").agg(F.collect_list(F.struct((F.col("start") - F.col("run")).alias("i"), "n", "source", (F.col("root") + F.col("start") + F.col("shift")).alias("at"))).alias("spans"))  # of one super-k-mer
    of_class = written(classes.select("key", "d1", "d2", "doc", F.col("start").alias("run")).join(spans, ["doc", "run"]).select("key", "d1", "d2", "spans"))
    forget(every, paths, classes)
    found = met.join(of_class, ["key", "d1", "d2"]).select("doc", "start", F.explode("spans").alias("s"))
    return found.select("doc", (F.col("start") + F.col("s.i")).alias("start"), F.col("s.n").alias("n"), "s.source", "s.at").where("not (doc = source and start = at)").select("doc", "start", "n")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc, text, spans): the windows of each document that occur earlier, in runs; null if none."""
    rows = keyed(docs, id_col, text_col)
    own = removed(rows, width, gram).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return rows.join(own, "doc", "left").select("doc", "text", "spans")


def digest(found: DataFrame, id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """id, n_words, n_removed and the SHA-256 of the words that are left, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(len(b)):
                words, mine = (b.column(1)[i].as_py() or b"").split(), b.column(2)[i]
                n_words = len(words)
                if mine.is_valid:
                    start, n = (mine.values.field(k).to_numpy() for k in range(2))
                    edge = np.zeros(n_words + 1, dtype=np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n - 1 + width, -1)
                    words = [w for w, gone in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not gone]
                out.append((n_words, n_words - len(words), sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=["id", "n", "r", "k"])

    bare = found.select("doc.id", "text", "spans")
    return bare.mapInArrow(run, f"`{id_col}` {bare.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string")
