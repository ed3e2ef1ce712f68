"""Quality rules: a threshold table compiled into one projection.

A rule is (measure, low, high): a document passes while low <= measure <= high, and a bound of None is open. ``judge`` turns the table into
columns of one select: every measure, one flag per rule, and their conjunction. Measures are built from built-in functions;
nothing is shuffled.

Defined results: a NULL text is an empty one; ratios over no words or no lines are 0, so that only length rules can fail an empty text;
an empty table of rules passes everything; repeated rows are judged each. Columns of the input with other names are kept
only where asked for by ``keep``.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from scanledger.functions.pixels import bind

from .words import SPACES, WORD_RUN, count_chars, whole, words

# fixed values: the characters that count as symbols, and frequent function words of four languages
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from which or have not but they his her had he she we you "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec il ce sont ou mais "
    "el los las y que una por con para del se no su al lo como más o pero sus").split()


class Rule(NamedTuple):
    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("n_words", 50, None),
    Rule("chars_per_word", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_ratio", 0.06, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
)


def ratio(part: Column, of: Column) -> Column:
    return F.when(of > 0, part.cast("double") / of).otherwise(F.lit(0.0))


def measures(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Counts of every text: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words.

    n_repeat_words: words in windows of three that occur twice or more in the text. The windows are compared by a 64-bit hash.
    """
    stop = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]
    kept = F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept")
    text = F.col("text")
    split = docs.select(kept, whole(F.col(text_col)).alias("text"))
    split = split.select("kept", text, words(text).alias("w"), F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_RUN)).alias("lines"))
    w = F.col("w")
    return split.select(
        "kept", F.size(w).cast("bigint").alias("n_words"), F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        count_chars(text, SYMBOLS).alias("n_symbols"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: x.isin(stop))).cast("bigint").alias("n_stop_words"), n_repeat_words(w).cast("bigint").alias("n_repeat_words"))


def n_repeat_words(w: Column) -> Column:
    """Words in windows of three words that occur twice or more in the array.

    The windows' hashes are sorted, only where one repeats, so that equal ones stand side by side. Each intermediate array is bound to a
    variable: however the optimizer moves the expression, an array is made once per evaluation and not once per element.
    """
    def window_hashes(w: Column) -> Column:
        return F.when(F.size(w) > 2, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bind(pairs, covered)).otherwise(F.lit(0))

    return F.coalesce(bind(bind(w, window_hashes), repeats), F.lit(0))


MEASURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: F.when(F.col("n_words") > 0, ratio(F.col("word_chars"), F.col("n_words"))).otherwise(F.lit(5.0)),
    "symbols_per_word": lambda: ratio(F.col("n_symbols"), F.col("n_words")),
    "stop_ratio": lambda: F.when(F.col("n_words") > 0, ratio(F.col("n_stop_words"), F.col("n_words"))).otherwise(F.lit(1.0)),
    "dup_line_ratio": lambda: ratio(F.col("n_dup_lines"), F.col("n_lines")),
    "repeat_ratio": lambda: ratio(F.col("n_repeat_words"), F.col("n_words")),
}


def passes(rule: Rule) -> Column:
    """One row of the threshold table as a condition."""
    value, bounds = MEASURES[rule.measure](), [F.lit(True)]
    if rule.low is not None:
        bounds.append(value >= F.lit(float(rule.low)))
    if rule.high is not None:
        bounds.append(value <= F.lit(float(rule.high)))
    out = bounds[0]
    for b in bounds[1:]:
        out = out & b
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, all counts, ``failed`` (the measures whose rule fails) and ``kept`` (none does)."""
    counts = measures(docs, text_col, keep)
    failed = F.array(*[F.when(~passes(r), F.lit(r.measure)) for r in rules]) if rules else F.array().cast("array<string>")
    failed = F.filter(failed, lambda x: x.isNotNull())
    rest = [c for c in counts.columns if c != "kept"]
    return counts.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *rest, failed.alias("failed"), (F.size(failed) == 0).alias("kept"))
