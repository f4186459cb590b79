"""Repeated byte strings by distributed prefix doubling, and what is left of each document.

A string of WIDTH bytes is repeated if the suffixes that start with it agree on WIDTH bytes. Positions get
ranks by a growing prefix; Spark groups the (rank, rank of the prefix that follows) pairs of all positions,
a pair becomes the rank of the longer prefix, and positions whose rank is unique leave.

Over every byte of a corpus that is a row of 28 bytes and more for each byte and round, so most positions
are settled before they become rows:

1. Sampled suffixes (``sampled``): every position is assigned the gram of GRAM bytes with the least hash in
   its string, so equal strings have equal grams at equal places. Consecutive positions with one gram
   occurrence are a *run*, one row. Runs with a unique gram have no repeated string and leave.
2. Runs that agree on all their bytes form a class. A gram all of whose runs agree is settled: repeated. So
   is a class with two places. One run stands for each class of the other grams.
3. Ranks of the sampled suffixes grow from the gram on, forwards and backwards (``narrowed``). Where one is
   unique at some length, positions whose strings reach so far from the gram leave their run.
4. Doubling (``doubled``): each position that is left is a row with the names of its first 64 bytes and of
   the bytes at the offsets to come. Ranks grow from 64 to 128 bytes at offset 64, and to WIDTH = 200 at
   offset 72 (prefixes overlap past the threshold). Unique ranks leave in each round.
5. Verification (``verified``): what is left is compared by a digest of 128 bits over the bytes at its
   coordinates. Classes are made of such digests to begin with; rolling hashes alone decide nothing.

Rounds run over ``slices`` of the grams, one after another, as equal strings have equal grams: it divides
the disk that ranks need and changes no result. All groupings are of longs with partial aggregation, so a
passage that a third of all documents share is one row for each task before it is shuffled.

Defined cases: null and empty texts have no bytes and keep none; texts under the threshold lose nothing;
ids may be of any type, null included; every row is a place of its own, so of rows that repeat entirely all
lose all (of WIDTH bytes and more); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import forget, written
from quern.llm.hashing import BASE, Prefix, digests, minimizer_runs, mixed

WIDTH, GRAM, SLICES = 200, 40, 2
#: A random value for each byte.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

RUN = "k bigint, tie bigint, start int, n int, off int, key bigint, d1 bigint, d2 bigint"
STRETCH = "k bigint, tie bigint, start int, n int, off int, key bigint, bytes binary"
#: A place as one long: only whether two are the same is asked of it.
PLACE = "xxhash64(k, tie, start)"


def _arrays(kinds: str, *columns) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in kinds.split(", ")), strict=True)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c).cast(arrow[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts end to end, and where each ends."""
    bare = texts.fill_null(b"")
    offsets = np.frombuffer(bare.buffers()[1], dtype=np.int32 if pa.types.is_binary(bare.type) else np.int64)[bare.offset : bare.offset + len(bare) + 1].astype(np.int64)
    if not len(bare):
        return np.zeros(0, dtype=np.uint8), offsets[:0]
    return np.frombuffer(bare.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k, tie, text, given): k and tie tell rows apart that differ in id or text."""
    own = F.col(id_col)
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    k = F.coalesce(own.cast("long"), F.lit(0)) if whole else F.xxhash64(own)
    return docs.select(k.alias("k"), F.xxhash64(own.isNull(), F.col(text_col), own).alias("tie"), F.col(text_col).cast("binary").alias("text"), own.alias("given"))


def sampled(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """The runs of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = flat(b.column(2))
            begins = np.r_[0, ends[:-1]]
            k, tie = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for start, n, off, key in minimizer_runs(values, ends, width, gram, BYTES):
                doc = np.searchsorted(ends, start, side="right")
                d = digests(values, start.tolist(), (start + n - 1 + width).tolist())
                yield _arrays(RUN, k[doc], tie[doc], start - begins[doc], n, off, key.view(np.int64), d[:, 0], d[:, 1])

    return rows.select("k", "tie", "text").mapInArrow(run, RUN)


def stretches(rows: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """The bytes of the chosen runs (k, tie, start, n, off, key)."""
    wanted = chosen.groupBy("k", "tie").agg(F.collect_list(F.struct("start", "n", "off", "key")).alias("runs"))  # of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                text, mine = b.column(2)[i].as_py(), b.column(3)[i].values
                start, n, off, key = (mine.field(j).to_numpy() for j in range(4))
                cut = pa.array(map(text.__getitem__, map(slice, start.tolist(), (start + n - 1 + width).tolist())), pa.binary())
                yield _arrays(STRETCH, *(np.full(len(start), b.column(j)[i].as_py(), dtype=np.int64) for j in range(2)), start, n, off, key, cut)

    return rows.select("k", "tie", "text").join(wanted, ["k", "tie"]).mapInArrow(run, STRETCH)


def reaches(width: int, gram: int) -> list[int]:
    """Lengths at which sampled suffixes are ranked: +length forwards, -length backwards, half as long again each time."""
    out, forth, back = [], gram + gram // 4, max(1, gram // 4)
    while forth < width:
        out.append(forth)
        forth += forth // 2 if forth > 1 else 1
    while back <= width - gram:
        out.append(-back)
        back += back // 2 if back > 1 else 1
    return out


def narrowed(cut: DataFrame, width: int, gram: int) -> DataFrame:
    """The stretches without the positions at either end whose strings hold a unique stretch that begins or ends at the gram."""
    lengths = reaches(width, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, len(b), 2048):
                own = b.slice(low, 2048)
                values, ends = flat(own.column(6))
                n, off, key, place = (own.column(j).to_numpy() for j in (3, 4, 5, 7))
                anchor = np.r_[0, ends[:-1]] + off if len(own) else off
                hashed, mixer = Prefix(BYTES[values]), key.view(np.uint64) * np.uint64(BASE)
                for length in lengths:
                    there = np.flatnonzero(length <= width - (off - n + 1) if length > 0 else -length <= off)
                    at = anchor[there]
                    name = hashed.of(at, at + length) if length > 0 else hashed.of(at + length, at)
                    yield _arrays("place bigint, length int, name bigint", place[there], np.full(len(there), length), mixed(name + mixer[there] + np.uint64(length + width)).view(np.int64))

    names = cut.select("*", F.expr(PLACE).alias("place")).mapInArrow(run, "place bigint, length int, name bigint")
    alone = names.groupBy("name").agg(F.min("place").alias("place"), F.max("place").alias("b"), F.max("length").alias("length")).where("place = b")
    alone = alone.groupBy("place").agg(F.min(F.when(F.col("length") > 0, F.col("length"))).alias("forth"), F.max(F.when(F.col("length") < 0, F.col("length"))).alias("back"))
    rows = cut.withColumn("place", F.expr(PLACE)).join(alone, "place", "left")
    # a position's string reaches ``off`` bytes before the gram and width - off from it on
    rows = rows.withColumn("most", F.expr("least(off, coalesce(-back - 1, off))")).withColumn("least", F.expr(f"greatest(off - n + 1, coalesce({width} - forth + 1, off - n + 1))")).where("most >= least")
    return rows.select("k", "tie", F.expr("start + off - most").alias("start"), F.expr("most - least + 1").alias("n"), F.col("most").alias("off"), "key", F.expr(f"substring(bytes, off - most + 1, most - least + {width})").alias("bytes"))


def steps(width: int) -> list[tuple[int, int]]:
    """(offset, length): the prefixes whose names make up the ranks, the first at offset 0; lengths double up to the width."""
    out, done = [(0, min(64, width))], min(64, width)
    while done < width:
        grown = min(2 * done, width)
        out.append((grown - done, done))
        done = grown
    return out


def positions(cut: DataFrame, width: int) -> DataFrame:
    """Each position of the stretches: (k, tie, start, run, rank, next_1, ...)."""
    parts = steps(width)
    kinds = "k bigint, tie bigint, start int, run int, rank bigint" + "".join(f", next_{j} bigint" for j in range(1, len(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, len(b), 2048):
                own = b.slice(low, 2048)
                values, ends = flat(own.column(6))
                k, tie, start, n, off, key = (own.column(j).to_numpy() for j in range(6))
                which = np.repeat(np.arange(len(own)), n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = np.r_[0, ends[:-1]][which] + nth
                hashed = Prefix(BYTES[values])
                names = [hashed.of(at + offset, at + offset + length) for offset, length in parts]
                # equal strings have their gram at equal places: that goes into the first rank
                place = (off[which] - nth).astype(np.uint64)
                names[0] = mixed(names[0] + key.view(np.uint64)[which] * np.uint64(BASE) + place)
                yield _arrays(kinds, k[which], tie[which], start[which] + nth, start[which], *(x.view(np.int64) for x in names))

    return cut.mapInArrow(run, kinds)


def shared(rows: DataFrame, *by: str) -> DataFrame:
    """The rows whose ``by`` is found at two places or more."""
    groups = rows.groupBy(*by).agg(F.min(F.expr(PLACE)).alias("_a"), F.max(F.expr(PLACE)).alias("_b")).where("_a <> _b").select(*by)
    return rows.join(groups, list(by))


def doubled(ranks: DataFrame, rounds: int) -> DataFrame:
    """(k, tie, start, run): positions whose rank is shared at each prefix length."""
    now = written(ranks)
    for j in range(rounds):
        kept = written(shared(now, "rank"))
        forget(now)
        now = kept if j == rounds - 1 else kept.withColumn("rank", F.xxhash64("rank", f"next_{j + 1}")).drop(f"next_{j + 1}")
        now._quern_path = kept._quern_path
    return now


def verified(left: DataFrame, cut: DataFrame, width: int) -> DataFrame:
    """(k, tie, start): the positions whose bytes are found at two places."""
    wanted = left.groupBy("k", "tie", F.col("run").alias("start")).agg(F.collect_list("start").alias("at"))  # of one run
    kinds = "k bigint, tie bigint, start int, d1 bigint, d2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = flat(b.column(3))
            sizes = b.column(4).value_lengths().to_numpy()
            which, at = np.repeat(np.arange(len(b)), sizes), b.column(4).flatten().to_numpy()
            k, tie, start = (b.column(j).to_numpy()[which] for j in range(3))
            begins = np.r_[0, ends[:-1]][which] + at - start if len(b) else at
            d = digests(values, begins.tolist(), (begins + width).tolist())
            yield _arrays(kinds, k, tie, at, d[:, 0], d[:, 1])

    found = written(cut.select("k", "tie", "start", "bytes").join(wanted, ["k", "tie", "start"]).mapInArrow(run, kinds))
    return shared(found, "d1", "d2").select("k", "tie", "start")


def repeated(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, slices: int = SLICES) -> DataFrame:
    """(k, tie, start, n): runs of n positions whose strings are found elsewhere too. rows: from keyed()."""
    span = ["k", "tie", "start", "n"]
    runs = written(sampled(rows, width, gram))
    place = F.xxhash64("k", "tie", F.col("start") + F.col("off"))
    several = (F.min("d1") != F.max("d1")) | (F.min("d2") != F.max("d2"))
    met = written(runs.join(runs.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b"), several.alias("several")).where("a <> b").select("key", "several"), "key"))
    forget(runs)
    found = [met.where("not several").select(*span)]
    branching = met.where("several").drop("several")
    classes = written(branching.groupBy("key", "d1", "d2").agg(F.min(F.struct("k", "tie", "start", "n", "off")).alias("one"), F.min(place).alias("a"), F.max(place).alias("b")))
    found.append(branching.join(classes.where("a <> b").select("key", "d1", "d2"), ["key", "d1", "d2"]).select(*span))
    whole = written(stretches(rows, classes.select("one.*", "key"), width))
    cut = written(narrowed(whole, width, gram))
    forget(whole)
    for s in range(slices):
        own = cut.where(F.pmod("key", F.lit(slices)) == s)
        left = doubled(positions(own, width), len(steps(width)))
        found.append(written(verified(left, own, width).select("k", "tie", "start", F.lit(1).alias("n"))))
        forget(left)
    forget(cut)
    # rows that repeat entirely are two places with one coordinate
    twice = rows.groupBy("k", "tie").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size")).where(f"n > 1 and size >= {width}")
    found.append(twice.select("k", "tie", F.lit(0).alias("start"), (F.col("size") - width + 1).cast("int").alias("n")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def covered(size: int, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Which of a document's bytes lie in one of its repeated strings."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, slices: int = SLICES) -> DataFrame:
    """(given, text, spans): the starts of repeated strings of ``width`` bytes in each document, in runs; null if none."""
    rows = keyed(docs, id_col, text_col)
    own = repeated(rows, width, gram, slices).groupBy("k", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return rows.join(own, ["k", "tie"], "left").select("given", "text", "spans")


def digest(found: DataFrame, id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(len(b)):
                text, mine = b.column(1)[i].as_py() or b"", b.column(2)[i]
                gone = n_spans = 0
                if mine.is_valid:
                    start, n = (mine.values.field(k).to_numpy() for k in range(2))
                    mask = covered(len(text), start, n, width)
                    gone, n_spans = int(mask.sum()), int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum())
                    text = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes()
                out.append((len(text) + gone, gone, n_spans, sha256(text).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["id", "n", "r", "s", "k"])

    kind = found.schema["given"].dataType.simpleString()
    return found.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
