"""Quality rules with a ledger of failure bits; DataFrame functions only.

Method: every rule is evaluated once per document. The ledger holds the measurements and one number whose bit k is
set if rule k failed. A policy is a versioned set of rules, that is, a mask: a document is kept under it if no bit of
the mask is set. Other policies, and the question what each rule alone removes (an ablation), are bitwise operations
on the ledger and never look at a text again.

Words are runs of characters other than white space (`[^\\x20\\x09-\\x0D]+`). The words of a document are split once;
all measurements come from that array inside the row, so nothing is shuffled, and a long text costs time in
proportion to n log n. Windows of eight words are told apart by a 64-bit hash within one document.

Defined results: a null or empty text has no words, fails the word count and is not kept; repeated rows are rows of
their own; measurement names that clash with columns of the input replace those.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: words of a window whose repetition counts, a power of two
WINDOW = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` worked out once: a lambda's argument is never inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(found: Column) -> Column:
    """Number of words inside windows of WINDOW words that occur twice or more, first occurrences included."""
    n = F.size(found) - (WINDOW - 1)

    def doubled(hashes: Column, span: int) -> Column:
        """Hashes of twice as many words: from those at i and at i + span."""
        if span == WINDOW:
            return F.slice(hashes, 1, F.size(hashes) - (WINDOW - 1))
        wider = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + span)))
        return let(wider, lambda w: doubled(w, 2 * span))

    def windows(hashes: Column) -> Column:
        return doubled(hashes, 1)

    def covered(sorted_windows: Column) -> Column:
        """The words covered by windows whose hash is that of a neighbour in the sorted list."""
        last = F.size(sorted_windows)

        def twin(w: Column, i: Column) -> Column:
            before = F.get(sorted_windows, F.greatest(i - 1, F.lit(0)))["h"] == w["h"]
            after = F.get(sorted_windows, F.least(i + 1, last - 1))["h"] == w["h"]
            return ((i > 0) & before) | ((i < last - 1) & after)

        places = F.sort_array(F.transform(F.filter(sorted_windows, twin), lambda w: w["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def count(all_windows: Column) -> Column:
        pairs = F.sort_array(F.transform(all_windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(all_windows)) < F.size(all_windows)
        return F.when(some, let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(n >= 2, let(let(hashes, windows), count)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements of every text."""
    clean = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(clean, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measures = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace(clean, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(clean, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w, i: (i > 0) & (F.get("_w", i - 1) == w))).cast("long").alias("n_adjacent_words"),
        F.length(F.regexp_replace(clean, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(clean, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    names = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_adjacent_words",
        "n_upper", "n_letters",
    ]
    rest = docs.drop(*names)
    kept = [c for c in rest.columns if c != "_w"]
    split = rest.select(*kept, words(F.col(text)).alias("_w"))
    # a generator of one row: a filter on a measurement is not moved below it, where all would be worked out once more
    # for each measurement the filter names
    return split.select(*kept, F.inline_outer(F.array(measures)))


@dataclass(frozen=True)
class Rule:
    """Bit `bit` of the ledger is set where `fails` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


#: shares are whole-number comparisons, so that any engine gets the same bits
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "repeated_neighbours", "100 * n_adjacent_words > 20 * n_words"),
    Rule(5, "capitals", "n_letters >= 40 AND 100 * n_upper > 30 * n_letters"),
    Rule(6, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(7, "few_letters", "2 * n_letters < word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that count."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICY = Policy("web-1", tuple(r.name for r in RULES))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with all measurements and `failed`, the bits of the rules that failed."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    return measured(docs, text).withColumn("failed", bits)


def passes(policy: Policy, failed: str = "failed") -> Column:
    """True where no rule of the policy failed."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(rows: DataFrame, policies: tuple[Policy, ...] = (POLICY,), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_only, n_kept_without) from a ledger: what each rule of each policy removes.

    `n_only` rows fail no other rule of the policy; `n_kept_without` rows would be kept if the rule were left out.
    The ledger is first counted by its bits: at most 2^rules rows, however many documents there are.
    """
    counts = rows.groupBy("failed").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    listed = [(p.version, p.mask, r.name, 1 << r.bit) for p in policies for r in rules if r.name in p.rules]
    wanted = spark.createDataFrame(listed, "version string, mask long, rule string, bit long")
    hits = F.col("failed").bitwiseAND(F.col("mask"))
    one = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    paired = counts.select("n", "failed", F.explode(F.array([F.lit(p.version) for p in policies])).alias("version"))
    return (
        paired.join(F.broadcast(wanted), "version")
        .groupBy("version", "rule")
        .agg(
            one(hits.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            one(hits == F.col("bit")).alias("n_only"),
            one(hits.bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
        )
    )
