"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document; its failure is one bit of ``rule_bits`` beside the measurements it
came from.  A policy is a versioned set of rules: applying one is a bitwise AND over the stored ledger, and the
ablation report counts documents by bit pattern (at most 2^rules rows) instead of reading texts again.

Defined results: a null text measures as an empty one (no words, ``too_few_words`` fails); repeated rows are measured
each for itself; columns of the input with the same names as the ledger's are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
_BLANKS = "\t\n\x0b\x0c\r"

#: Rules in bit order, as conditions over the measurements; a rule that holds is a failure.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "2 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("too_few_words", "repeated_trigrams")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": BASE + ("symbol_heavy", "repeated_lines", "short_words", "long_words"),
}


def _with(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with columns given by name."""
    return frame.withColumns(columns)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every whole text: no shuffle, arrays of one document at a time."""
    body = F.coalesce(F.col(text), F.lit(""))
    frame = _with(docs, _words=F.array_remove(F.split(F.translate(body, _BLANKS, " " * len(_BLANKS)), " "), ""), _lines=F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    frame = _with(
        frame,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.translate(body, " " + _BLANKS, "")).cast("long"),
        n_symbols=(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        n_lines=F.size("_lines").cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _grams=F.transform(
            F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda word, i: F.concat(word, F.lit(" "), F.get("_words", i + 1), F.lit(" "), F.get("_words", i + 2)),
        ),
    )
    # Equal 3-word windows meet by sorting; a window is repeated if it equals a neighbour in sorted order.
    repeated = F.size("_grams") > F.size(F.array_distinct("_grams"))
    frame = _with(frame, _sorted=F.when(repeated, F.sort_array(F.transform("_grams", lambda gram, i: F.struct(gram.alias("g"), i.alias("at"))))))
    flagged = F.transform(
        "_sorted",
        lambda x, i: F.when(x["g"].eqNullSafe(F.get("_sorted", i - 1)["g"]) | x["g"].eqNullSafe(F.get("_sorted", i + 1)["g"]), x["at"]),
    )
    frame = _with(frame, _starts=F.sort_array(F.array_compact(flagged)))
    covered = F.aggregate(
        F.transform("_starts", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("_starts", i + 1) - at, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    frame = _with(frame, n_repeat_words=F.coalesce(covered, F.lit(0)).cast("long"))
    return frame.drop("_words", "_lines", "_grams", "_sorted", "_starts")


def ledger(docs: DataFrame, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """The documents with measurements and ``rule_bits``: bit k is set where the k-th rule fails the document."""
    bits = F.lit(0).cast("long")
    for k, condition in enumerate((rules or RULES).values()):
        bits = bits + F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    # A value the optimizer can't compute twice: without it, a filter on the bits would be pushed below the measurements
    # and evaluate them again inside its condition.
    fixed = F.when(F.monotonically_increasing_id() >= 0, bits)
    return measure(docs, text).withColumn("rule_bits", fixed)


def mask_of(names: Sequence[str], rules: dict[str, str] | None = None) -> int:
    """The bits of the named rules."""
    order = list(rules or RULES)
    return sum(1 << order.index(name) for name in names)


def apply_policy(book: DataFrame, version: str = "v1", policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Add ``kept``: no rule of the policy fails. Reads the stored bits only."""
    mask = mask_of((policies or POLICIES)[version])
    return book.withColumn("kept", F.col("rule_bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(book: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first counted by bit pattern, so what follows has as many rows as there are patterns.
    """
    names = POLICIES[version]
    mask = mask_of(names)
    patterns = book.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask_of([name])).cast("long").alias("bit")) for name in names])
    each = patterns.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only_this"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
