"""Secret scans, DataFrame expressions only.

Fixed patterns give the base kinds. Beyond them, long tokens are scored by two first-order
character Markov models, one of random strings and one of ordinary identifiers: the
log-likelihood ratio decides. Both are trained from labelled samples (train()); the default
samples are generated by a seeded rule. The trained table is one literal array of
|alphabet| x (|alphabet| + 1) ratios, so scoring stays within the JVM.
"""

from __future__ import annotations

import math
import random
import string
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import free_name, let, text_of

# The base kinds, in the order of ties.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Whatever has none of these has no assign match; much cheaper to look for.
ASSIGN_HINT = r"[pPsStTaA](?i:assw|ecret|oken|pi_?key)"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Shortest token that the Markov models judge; they call it random above this ratio, in all and a character.
MIN_RANDOM, LEAST_RATIO, LEAST_MEAN = 20, 25.0, 0.8
#: A random stretch of an ordinary token ends where the summed ratio has fallen this far below its highest.
DROP = 12.0

# ---- training ----

_SYLLABLES = "get set list user name file data time key value count index item node page text byte read write open close link path type size hash sort find make load save send call test main init core base view model table query column order group join filter window stream batch block chunk frame event error state cache queue stack tree graph edge score label token parse build merge split check print format string number".split()
_WORDS = "the and for that with this from have were been their which would there about other these people could first after water where every think great never under while might should still house world between country school father important children without together through something different international understanding responsibility communication development government environment information organization".split()


def labelled_samples(seed: int = 11, n: int = 4000) -> list[tuple[str, int]]:
    """(token, 1 if random): random strings over common alphabets; identifiers, words run together, paths and numbers of versions."""
    rng = random.Random(seed)
    alphabets = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "_-"]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))), 1) for _ in range(n)]
    pieces = _SYLLABLES + _WORDS
    vowels, consonants = "aeiou", "bcdfghjklmnpqrstvwxyz"
    for _ in range(n):
        parts = [rng.choice(pieces) for _ in range(rng.randint(3, 7))]
        kind = rng.randrange(6)
        if kind == 0:
            token = "_".join(parts)
        elif kind == 1:
            token = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif kind == 2:
            token = "-".join(parts) + (f"-{rng.randint(1, 2030)}" if rng.random() < 0.4 else "")
        elif kind == 3:
            token = "/".join(parts)
        elif kind == 4:
            token = "".join(rng.choice(consonants) + rng.choice(vowels) + rng.choice(["", "n", "r", "s", "t", "l"]) for _ in range(rng.randint(7, 14)))
        else:
            token = rng.choice(["=", "-", "_"]) * rng.randint(10, 40) if rng.random() < 0.3 else "_".join(parts).upper()
        out.append((token, 0))
    return out


def train(samples: Iterable[tuple[str, int]]) -> list[float]:
    """Log-likelihood ratios random : ordinary, at [previous * |alphabet| + this]; previous 0 is the start of a token. Add-one smoothing."""
    size = len(ALPHABET)
    at = {c: k for k, c in enumerate(ALPHABET)}
    counts = [defaultdict(float), defaultdict(float)]
    for token, label in samples:
        before = 0
        for c in token:
            if c in at:
                counts[label][before, at[c]] += 1
                before = at[c] + 1
    out = []
    for before in range(size + 1):
        sums = [sum(counts[y][before, k] for k in range(size)) + size * 0.5 for y in (0, 1)]
        out += [round(math.log((counts[1][before, k] + 0.5) / sums[1]) - math.log((counts[0][before, k] + 0.5) / sums[0]), 4) for k in range(size)]
    return out


@lru_cache(maxsize=1)
def default_table() -> tuple[float, ...]:
    return tuple(train(labelled_samples()))


def ratio_of(token: str, table: Iterable[float]) -> float:
    """The score in plain Python, for tests."""
    table, before, total = list(table), 0, 0.0
    for c in token:
        k = ALPHABET.index(c)
        total += table[before * len(ALPHABET) + k]
        before = k + 1
    return total


# ---- scanning ----

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _empty() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: str, rank: int, keep=None, group: int | None = None, parts=None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: the pieces between matches and the matches alternate.

    keep(match) says which of them count, parts(match) instead gives the stretches (from, to) of a match that do.
    """
    p = F.lit(pattern)

    def placed(pieces: Column) -> Column:
        zipped = F.arrays_zip(
            F.transform(pieces, lambda x: F.length(x)).alias("gap"),
            F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x)).alias("len"),
            *([F.regexp_extract_all(text, p, F.lit(group)).alias("value")] if group is not None else []),
        )
        start = F.struct(F.lit(0).alias("at"), _empty().alias("out"))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + x["len"]
            span = lambda a, b: F.struct(a.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), b.alias("end"))
            found = F.transform(parts(x), lambda p: span(begin + p["from"], begin + p["to"])) if parts else F.array(span(begin, end))
            wanted = x["len"].isNotNull() & (keep(x) if keep else F.lit(True))
            return F.struct(F.coalesce(end, begin).alias("at"), F.when(wanted, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(zipped, start, step, lambda acc: acc["out"])

    return let(F.split(text, pattern, -1), lambda pieces: F.when(F.size(pieces) > 1, placed(pieces)).otherwise(_empty()))


def base_spans(text: Column) -> Column:
    """Sorted spans of the base kinds. For access and hex a long match is found as such: a shorter one never hides it."""
    return F.sort_array(
        F.concat(
            F.when(text.rlike(ASSIGN_HINT), _spans(text, ASSIGN, "assign", 0, keep=lambda x: F.length(x["value"]) >= MIN_ASSIGN, group=2)).otherwise(_empty()),
            _spans(text, rf"{ACCESS[:-1]}{{{MIN_ACCESS - 4},}}", "access", 1),
            _spans(text, rf"{HEX[:-1]}{{{MIN_HEX},}}", "hex", 2),
        )
    )


def _ratios(token: Column, table: Iterable[float]) -> Column:
    """The log-likelihood ratio of each character of a token, given the one before."""
    size = len(ALPHABET)
    ratios = F.lit(list(table))
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(places, lambda p: F.transform(p, lambda x, k: F.get(ratios, F.coalesce(F.get(p, k - 1), F.lit(0)) * size + x - 1)))


def _total(ratios: Column) -> Column:
    return F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x)


def random_ratio(token: Column, table: Iterable[float]) -> Column:
    return _total(_ratios(token, table))


_STRETCH = "array<struct<from:int,to:int>>"


def _is_random(ratio: Column, length: Column) -> Column:
    return (ratio >= LEAST_RATIO) & (ratio >= length * LEAST_MEAN)


def _stretches(token: Column, ratios: Column) -> Column:
    """(from, to) of the random stretches of a token that isn't random as a whole: from where the summed ratio rises above zero to its highest
    before it falls by DROP or to zero again; widened to the separators around it, since its ends may look ordinary."""
    fresh = lambda at, out: F.struct(at.alias("at"), at.alias("from"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), at.alias("to"), out.alias("out"))

    def ended(acc: Column) -> Column:
        span = F.struct(acc["from"].alias("from"), acc["to"].alias("to"))
        return F.when(_is_random(acc["best"], acc["to"] - acc["from"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])

    def step(acc: Column, ratio: Column) -> Column:
        total, at = acc["sum"] + ratio, acc["at"] + 1
        higher = total > acc["best"]
        on = F.struct(at.alias("at"), acc["from"].alias("from"), total.alias("sum"), F.greatest(total, acc["best"]).alias("best"), F.when(higher, at).otherwise(acc["to"]).alias("to"), acc["out"].alias("out"))
        return F.when((total <= 0) | (total <= acc["best"] - DROP), fresh(at, ended(acc))).otherwise(on)

    def widened(s: Column) -> Column:
        before = F.length(F.regexp_extract(F.substring(token, F.lit(1), s["from"]), "[A-Za-z0-9+]*$", 0))
        after = F.length(F.regexp_extract(F.substring(token, s["to"] + 1, F.length(token)), "^[A-Za-z0-9+]*", 0))
        return F.struct((s["from"] - before).alias("from"), (s["to"] + after).alias("to"))

    found = F.aggregate(ratios, fresh(F.lit(0), F.array().cast(_STRETCH)), step, ended)
    return F.array_distinct(F.filter(F.transform(found, widened), lambda s: s["to"] - s["from"] >= MIN_RANDOM))


def random_spans(text: Column, table: Iterable[float] | None = None) -> Column:
    """Spans of kind random: long tokens that the models hold for random strings, and of other long tokens such stretches, as after a path or a name."""
    table = default_table() if table is None else table

    def parts(x: Column) -> Column:
        token = x["value"]
        whole = F.array(F.struct(F.lit(0).alias("from"), F.length(token).alias("to")))
        return let(_ratios(token, table), lambda r: F.when(_is_random(_total(r), F.length(token)), whole).otherwise(_stretches(token, r)))

    return _spans(text, rf"\b[A-Za-z0-9_][A-Za-z0-9+/_=-]{{{MIN_RANDOM - 1},}}+", "random", 3, group=0, parts=parts)


def all_spans(base: Column, found: Column) -> Column:
    """Base spans, and of the others those that reach out of each of them: redacted() merges what overlaps."""
    return F.sort_array(F.concat(base, F.filter(found, lambda r: ~F.exists(base, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))))


def digest_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """df with two arrays of (start, rank, kind, end): the base spans, and all spans. Null and empty texts have none. The two names must be new to df."""
    if {base.lower(), spans.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"df has a column {base} or {spans} already; name others")
    t = text_of(text)
    both = let(base_spans(t), lambda b: F.struct(b.alias("base"), all_spans(b, random_spans(t)).alias("spans")))
    return df.withColumn(spans, both).withColumn(base, F.col(f"{spans}.base")).withColumn(spans, F.col(f"{spans}.spans"))


def secret_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have no spans; repeated rows give a row each; no rows give no rows. Other columns are ignored.
    """
    count = lambda kind: F.size(F.filter("b", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = with_spans(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), base="b", spans="s")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest_of(F.col("b")), 256).alias("base_sha256"), digest_of(F.col("s")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by [secret]; sorted spans expected."""
    mark = F.lit("[secret]")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(fresh & ((acc["at"] == 0) | (s["start"] > acc["at"])), F.concat(acc["out"], gap, mark)).when(fresh, acc["out"]).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redact(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """df with secrets replaced in its texts and, where that column exists, n_chars recounted for them.

    Null texts stay null; repeated rows and all other columns, whatever their names, stay as they are.
    """
    base, spans, new = free_name(df, "base_spans", "secret_spans", "redacted")
    out = with_spans(df, text, base, spans).withColumn(new, F.when(F.size(spans) > 0, redacted(F.col(text), F.col(spans))))
    changed = out.withColumn(text, F.coalesce(new, F.col(text)))
    if n_chars in df.columns:
        changed = changed.withColumn(n_chars, F.when(F.col(new).isNotNull(), F.length(text).cast(df.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return changed.select(*df.columns)
