"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one failure bit for
each rule; a policy is a named, versioned mask over those bits, so policies are applied, compared and
ablated on the ledger alone, without reading a text again.

Defined cases: a null text counts as empty (no words, fails ``short``); an empty table gives an empty
ledger; repeated rows are measured each on their own; extra columns of the input are ignored, whatever
their names, since only the id and the text are selected.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import common

SYMBOLS = "#*$%&|<>"

#: Rule name -> condition under which a document fails, over the ledger's measurements. The bit of a
#: rule is its place here: append, never reorder, or stored ledgers change their meaning.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 4 * n_words",
    "shouting": "100 * n_upper > 60 * word_chars",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "long_words": "word_chars > 20 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A version of the rules: a document is rejected when more than ``allowed`` of ``rules`` fail."""

    version: str
    rules: tuple[str, ...] = field(default=tuple(RULES))
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)

    def keeps(self, bits: Column) -> Column:
        return F.bit_count(bits.bitwiseAND(F.lit(self.mask).cast("long"))) <= self.allowed


BASE = Policy("base", ("short", "repetitive"))
CURRENT = Policy("2")


#: Hashes of the 3-word windows of the words ``w``, in order.
WINDOWS = "if(size(w) < 3, array(), transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])))"


def _repeat_words() -> Column:
    """Words in 3-word windows that the text has twice or more, the first such window included.

    Most texts repeat no window, which one pass over the hashes ``h`` shows. In the others, windows are
    sorted by (hash, place) within the row, so equal ones become neighbours; no window leaves its row,
    and the cost is n log n for the longest text.
    """
    twice = "filter(s, (x, j) -> coalesce(x.h = get(s, j - 1).h, false) or coalesce(x.h = get(s, j + 1).h, false))"
    # the one-element array gives the sorted windows a name, so that they are sorted once
    places = f"sort_array(transform(array(sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))), s -> transform({twice}, x -> x.i))[0])"
    covered = f"aggregate({places}, named_struct('last', -3, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    return F.expr(f"if(size(h) = size(array_distinct(h)), 0, {covered})").cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """One row per document: id, measurements and ``fail_bits``. ``keep``: further input columns to carry."""
    kept = [F.col(c) for c in keep if c != id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != "")
    without = lambda chars: (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")
    base = docs.select(F.col(id_col), *kept, common.words(F.col(text_col)).alias("w"), lines.alias("ls"), without(SYMBOLS).alias("n_symbols"), without("A-Z").alias("n_upper"), (F.length(text) - without(r"\x20\x09-\x0D")).cast("long").alias("word_chars"))
    base = base.withColumn("h", F.expr(WINDOWS))
    measured = base.select(
        F.col(id_col), *kept, F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"), _repeat_words().alias("n_repeat_words"), F.size("ls").cast("long").alias("n_lines"), "n_upper",
    )
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy = CURRENT, into: str = "kept") -> DataFrame:
    return rows.withColumn(into, policy.keeps(F.col("fail_bits")))


def passing(docs: DataFrame, policy: Policy = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that a policy keeps.

    A filter on the verdict would be pushed below the measurements, and every measurement that it uses
    computed anew inside it. The row's number is of no other use than to stop that.
    """
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col(id_col), F.col(text_col))
    judged = apply_policy(ledger(rows, id_col, text_col, keep=["_row"]), policy, "_kept").select("_row", "_kept", F.monotonically_increasing_id().alias("_no"))
    return judged.where(F.col("_kept") & (F.col("_no") >= 0)).select("_row.*")


def ablation(rows: DataFrame, policies: Iterable[Policy] = (CURRENT,)) -> DataFrame:
    """For each policy and each of its rules: documents, kept, rejected by that rule alone, kept without it.

    The ledger shrinks to a count for each bit pattern first (at most 2 ** rules rows), and all
    policies and rules are answered by bit operations on those.
    """
    patterns = rows.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    ask = [(p.version, r, p.mask, 1 << list(RULES).index(r), p.allowed) for p in policies for r in p.rules]
    asked = F.explode(F.array(*(F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit"), F.lit(a).alias("allowed")) for v, r, m, b, a in ask)))
    x = patterns.select("fail_bits", "n", asked.alias("a")).select("fail_bits", "n", "a.*")
    fails = F.bit_count(F.expr("fail_bits & mask"))
    without = F.bit_count(F.expr("fail_bits & mask & ~bit"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return x.groupBy("policy", "rule").agg(
        F.sum("n").alias("n_docs"), count(F.expr("fail_bits & bit") != 0).alias("n_fail"), count(fails <= F.col("allowed")).alias("n_kept"),
        count((fails > F.col("allowed")) & (without <= F.col("allowed"))).alias("n_kept_only_without"),
    )
