"""Quality rules as a short-circuit cascade, DataFrame expressions only.

Each rule is a predicate that rejects a text. Cost (seconds a text) and selectivity (share
rejected) of every rule are estimated on a bounded sample; the cascade evaluates rules by
rejection per cost, best first, and stops at the first that rejects. The order changes
only the work: a text is kept if and only if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import SPACE_CHARS, dropped, free_name, let, text_of, written

#: Rows of the sample on which costs and selectivities are estimated; it serves for nothing else.
SAMPLE_ROWS = 200
#: A rule is timed over so many copies of the sample, so often.
COPIES, REPEATS = 5, 3

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.1
#: Characters of a text, white space included, to a word.
MIN_MEAN_WORD, MAX_MEAN_WORD = 2.5, 20.0
MAX_SHOUT = 0.2
MAX_UPPER = 0.4
MAX_DUP_LINES = 0.5
SYMBOLS = "#*$%&|<>"
#: Recurring windows up to this number are looked up one by one.
FEW_WINDOWS = 12


def words_of(text: Column) -> Column:
    for c in SPACE_CHARS[1:]:  # one kind of space is split far faster than a class of them
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared by 64-bit hash.

    A hash set tells most texts, in which no window recurs. A few recurring windows are looked
    up in every position; where they are many, sorted (hash, position) pairs put equal windows
    side by side, n log n for any text.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def looked_up(h: Column, again: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())

    def side_by_side(h: Column) -> Column:
        def repeated(s: Column) -> Column:
            at = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
            return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)

    def recurring(h: Column) -> Column:
        again = let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k - 1))))
        return let(again, lambda d: let(F.when(F.size(d) <= FEW_WINDOWS, looked_up(h, d)).otherwise(side_by_side(h)), covered))

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), recurring(h)))
    return F.coalesce(F.when(n >= 3, counted), F.lit(0)).cast("long")


def n_repeat_words(text: Column) -> Column:
    return let(words_of(text), repeat_words)


def n_shouted(text: Column) -> Column:
    """Runs of two or more exclamation marks."""
    return F.size(F.regexp_extract_all(text, F.lit("!!+"), F.lit(0)))


def n_upper(text: Column) -> Column:
    """Upper-case letters."""
    return F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))


@dataclass(frozen=True)
class Rule:
    name: str
    #: (text, its number of words) -> True where the rule rejects.
    rejects: Callable[[Column, Column], Column]
    base: bool = False


RULES = [
    Rule("short", lambda t, n: n < MIN_WORDS, base=True),
    Rule("repetitive", lambda t, n: n_repeat_words(t) * 100 > n * MAX_REPEAT_PERCENT, base=True),
    Rule("symbols", lambda t, n: n_symbols(t) > n * MAX_SYMBOLS_PER_WORD),
    Rule("word_length", lambda t, n: (F.length(t) < n * MIN_MEAN_WORD) | (F.length(t) > n * MAX_MEAN_WORD)),
    Rule("shouting", lambda t, n: n_shouted(t) > n * MAX_SHOUT),
    Rule("upper_case", lambda t, n: n_upper(t) > F.length(t) * MAX_UPPER),
    Rule("duplicate_lines", lambda t, n: let(_lines(t), lambda x: (F.size(x) - F.size(F.array_distinct(x))) > F.size(x) * MAX_DUP_LINES)),
]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    #: Seconds a text.
    cost: float
    #: Whether the rule rejects, for each text of the sample.
    rejected: tuple[bool, ...]


def estimate(df: DataFrame, text: str, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """What each rule costs and rejects, on a sample of at most `rows` texts. A rule is timed REPEATS times over COPIES of the sample; the least time counts."""
    sample = written(df.select(text_of(text).alias("text")).sample(fraction=0.1, seed=7).limit(rows).coalesce(1), "sample")
    if not sample.limit(1).count():
        dropped(sample)
        sample = written(df.select(text_of(text).alias("text")).limit(rows).coalesce(1), "sample")
    words = n_words(F.col("text"))
    verdicts = [r.rejects(F.col("text"), F.col("n")) for r in rules]
    hits = sample.select("text", words.alias("n")).select(*(F.coalesce(v, F.lit(False)).alias(f"r{k}") for k, v in enumerate(verdicts))).collect() if rules else []
    copies = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).select("text", words.alias("n"))

    def timed(condition: Column) -> float:
        seconds = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            copies.agg(F.sum(condition.cast("int"))).first()
            seconds.append(time.perf_counter() - began)
        return min(seconds)

    n = max(len(hits), 1)
    idle = timed(F.col("n") >= 0)
    costs = [max(timed(v) - idle, idle / 20) / (n * COPIES) for v in verdicts]
    dropped(sample)
    return [Estimate(rule, cost, tuple(h[k] for h in hits)) for k, (rule, cost) in enumerate(zip(rules, costs))]


def ordered(estimates: list[Estimate]) -> list[Rule]:
    """By rejection per cost among the texts that the rules before have left, best first; rules that reject nothing more follow by cost."""
    left, out = list(estimates), []
    alive = [True] * max((len(e.rejected) for e in estimates), default=0)
    while left:
        gain = lambda e: sum(a and r for a, r in zip(alive, e.rejected)) / max(e.cost, 1e-9)
        best = min(left, key=lambda e: (-gain(e), e.cost, e.rule.name))
        alive = [a and not r for a, r in zip(alive, best.rejected)]
        left.remove(best)
        out.append(best.rule)
    return out


def cascade(rules: list[Rule], text: Column, words: Column) -> Column:
    """True if no rule rejects; a rule is evaluated only where all before it have passed."""
    verdict = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.rejects(text, words), F.lit(False))
    return verdict.otherwise(F.lit(True))


def quality_filter(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of df whose text no rule rejects, with df's columns. Null texts count as empty and are rejected as short."""
    rules = ordered(estimate(df, text, RULES if rules is None else rules))
    t = text_of(text)
    return df.where(let(n_words(t), lambda n: cascade(rules, t, n)))


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """A row per row of df: doc_id, the base measures, base_failed and kept.

    Null and empty texts have zero measures and fail. Repeated rows give a row each. Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    later = ordered(estimate(df, text, [r for r in rules if not r.base]))
    t = text_of(text)
    [m] = free_name(df, "measures")
    measures = let(
        words_of(t),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words")),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return (
        df.select(F.col(doc_id).alias("doc_id"), t.alias("text"))
        .withColumn(m, measures)
        .select("doc_id", f"{m}.*", "text")
        .withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(later, F.col("text"), F.col("n_words"))))
        .drop("text")
    )
