"""Quality rules kept as a ledger: measurements and one failure bit for each rule, evaluated once.

The ledger holds, for each document, what was measured and a mask whose bit r says that rule r failed. A
policy is a named, versioned set of rules: a document is kept under it if no bit of the policy's mask is set. So
changing a policy, comparing two, or asking what each rule costs reads two columns and no text.

Everything is a column expression: measuring needs no shuffle and no Python, whatever a text's length.
Windows of words are compared by 64-bit hashes within their own text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import text_or_empty

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the mask, its name, and when a document fails, over the ledger's measurements."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule, so that masks written earlier keep their meaning.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "capitals", "2 * n_upper > word_chars AND n_words >= 5"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "exclamations", "2 * n_exclaimed > n_words AND n_words >= 5"),
)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << r.bit for r in RULES if r.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
POLICIES = {(p.name, p.version): p for p in (BASE, Policy("corpus", 1, tuple(r.name for r in RULES)), Policy("corpus", 2, ("few_words", "repeated_words", "symbols", "capitals", "repeated_lines", "exclamations")))}
CURRENT = POLICIES["corpus", 2]


def _without(text: Column, letters: str) -> Column:
    return F.translate(text, letters, "")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaimed.

    Null texts are empty. Only doc_id and text are read, whatever else ``docs`` has."""
    long = lambda c: c.cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select(
        "doc_id",
        long(F.length(_without(F.col("text"), _SPACE))).alias("word_chars"),
        long(F.length("text") - F.length(_without(F.col("text"), _SYMBOLS))).alias("n_symbols"),
        long(F.length("text") - F.length(_without(F.col("text"), "!"))).alias("n_exclaimed"),
        long(F.regexp_count("text", F.lit("\\p{Lu}"))).alias("n_upper"),
        F.filter(F.split("text", "\n", -1), lambda x: F.length(_without(x, _SPACE)) > 0).alias("lines"),
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+", -1), lambda x: x != "").alias("words"),
    )
    rows = rows.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        "n_exclaimed",
        "n_upper",
        long(F.size("words")).alias("n_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, WINDOW)))).alias("windows"),
    )
    # windows in the order of their hashes with their places, only where some repeat
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.expr("filter(sorted, (w, k) -> (k > 0 AND sorted[greatest(k - 1, 0)].h = w.h) OR (k + 1 < size(sorted) AND sorted[least(k + 1, size(sorted) - 1)].h = w.h))")
    rows = rows.withColumn("places", F.array_sort(F.transform(same, lambda w: w["i"])))
    covered = F.expr(f"aggregate(places, named_struct('n', 0L, 'last', -{WINDOW}), (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p), a -> a.n)")
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaimed")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and failed_bits (long): every rule, evaluated once."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured(docs).withColumn("failed_bits", mask)


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: rule, failed (documents that fail it) and alone (that fail no other), of
    one aggregate over the ledger; and what all documents fail or none do, by AND and OR of the masks."""
    own = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    rules = [r for r in RULES if policy.mask >> r.bit & 1]
    sums = [x for r in rules for x in (F.count_if(own.bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).alias(f"f{r.bit}"), F.count_if(own == (1 << r.bit)).alias(f"a{r.bit}"))]
    totals = rows.agg(F.count("*").alias("documents"), F.count_if(own != 0).alias("rejected"), F.bit_or(own).alias("any_bits"), F.bit_and(own).alias("all_bits"), *sums)
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("failed"), F.col(f"a{r.bit}").alias("alone")) for r in rules])
    return totals.select("documents", "rejected", "any_bits", "all_bits", F.explode(each).alias("r")).select("r.*", "documents", "rejected", "any_bits", "all_bits")


def judged(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_bits.

    One row for each row of ``docs``; repeated and null ids stay. A text without words fails as too short."""
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(policy)).alias("kept"), "failed_bits")
