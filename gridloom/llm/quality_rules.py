"""Quality rules: a threshold table that becomes one projection (no user functions).

Defined results: a null text is an empty one; it has no words, so it fails.
Repeated rows are judged row by row, each alike. No row is dropped, nothing is shuffled. An empty table gives an empty one, a very long text
is measured whole, and a measure at its limit passes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, all_stop_words, fresh, let, split_words

SYMBOLS = r"[#*$%&|<>]"
#: Up to this many distinct repeated windows, membership is tested by a scan of their list.
FEW = 32
NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= numerator / denominator <= high (a denominator of 0 passes)."""

    name: str
    numerator: str
    denominator: str
    low: float = float("-inf")
    high: float = float("inf")


#: Wide limits: they refuse noise and markup, not plain prose in any of the corpus languages.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("line_length", "n_words", "n_lines", low=1.5),
)


def _covered(starts: Column) -> Column:
    """Words inside the 3-word windows that begin at the ascending starts."""
    gaps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _starts_few(windows: Column, repeated: Column) -> Column:
    marked = F.transform(windows, lambda x, i: F.when(F.array_contains(repeated, x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _starts_many(windows: Column) -> Column:
    """By sorting (window, place), so that a text of any length costs n log n."""

    def of(s: Column) -> Column:
        same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
        return F.sort_array(
            F.transform(
                F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False)) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"]))),
                lambda x: x["i"],
            ),
        )

    return let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of)


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, among))

    def among(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(h), lambda s: with_sorted(h, s)))

    def with_sorted(h: Column, s: Column) -> Column:
        repeated = F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0))) == x)))
        return let(repeated, lambda r: F.when(F.size(r) <= FEW, let(_starts_few(h, r), _covered)).otherwise(let(_starts_many(h), _covered)))

    return let(words, of).cast("long")


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The columns that rules may name, as expressions over the whole text, its words and its lines with a word."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_window_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(all_stop_words()))).cast("long"),
    }


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures, base_failed, failed_rules and kept."""

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        failed = F.filter(F.array(*[F.when(~_passes(r, m), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return F.struct(
            *[m[k].alias(k) for k in NAMES],
            base.alias("base_failed"),
            failed.alias("failed_rules"),
            (~base & (F.size(failed) == 0)).alias("kept"),
        )

    def measured(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
        return let(split_words(t), lambda w: let(lines, lambda n: F.struct(*[v.alias(k) for k, v in measures(t, w, n).items()])))

    return let(let(F.coalesce(text, F.lit("")), measured), judged)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with a struct column `quality` (underscores appended if docs has one already), see verdict()."""
    return docs.withColumn(fresh(docs, "quality")[0], verdict(F.col(text), rules))


def _passes(rule: Rule, m: Column) -> Column:
    n, d = m[rule.numerator], m[rule.denominator]
    ok = F.lit(True)
    if rule.low != float("-inf"):
        ok = ok & (n >= F.lit(rule.low) * d)
    if rule.high != float("inf"):
        ok = ok & (n <= F.lit(rule.high) * d)
    return ok


def op8(docs: DataFrame) -> DataFrame:
    q = F.col("quality")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]
    return judge(docs.select("doc_id", "text")).select(
        "doc_id",
        *[(F.array_join(q[n], ",") if n == "failed_rules" else q[n]).alias(n) for n in names],
    )
