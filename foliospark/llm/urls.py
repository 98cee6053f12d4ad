"""URL filters by a sort-merge range join.

A rule (host, path) becomes the prefix interval of one canonical key: the host's labels
reversed, a separator, the path. A url is looked up under the key of its host and of each
parent host. A batch's keys are sorted and swept together with the sorted rules; a stack
keeps the active rules, each nested in the one below it, so its top is the longest path that
fits. Rules go to the tasks in chunks of bounded size, one pass of the batch each: no shuffle,
and no row of the urls moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import free_name

#: Rules that one pass ships to the tasks, and bytes of their text; more rules make more passes.
CHUNK_RULES, CHUNK_BYTES = 100_000, 16 << 20
SEPARATOR = "\t"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): between the first :// and /, ?, # or end, A-Z lower-cased; then up to ?, # or end. Null or no ://: empty."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min((k for k in (path.find(c) for c in "?#") if k >= 0), default=len(path))
    return host.translate(_LOWER), path[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def canonical(labels: list[str], path: str) -> str:
    return ".".join(labels) + SEPARATOR + path


def sweep(keys: list[tuple[str, int]], rules: list[tuple[str, int]]) -> Iterator[tuple[int, int]]:
    """(row, rule) for each key within a rule's interval, innermost rule only. Both lists sorted by key."""
    stack: list[tuple[str, int]] = []
    at = 0
    for key, row in keys:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if stack:
            yield row, stack[-1][1]


def chunks(rules: list[UrlRule]) -> list[list[UrlRule]]:
    out: list[list[UrlRule]] = [[]]
    size = 0
    for r in rules:
        n = len(r.name.encode()) + 64
        if len(out[-1]) >= CHUNK_RULES or size + n > CHUNK_BYTES and out[-1]:
            out.append([])
            size = 0
        out[-1].append(r)
        size += n
    return [c for c in out if c]


def judge_urls(df: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict of each url (underscored where df has such columns).

    The rule with the longest host and path wins; of two as long, that with the longer host,
    then block, then the first given. Null urls and urls without :// have empty parts; what no rule fits
    has a null rule and the verdict `default`. Repeated rows give a row each.
    """
    host, path, rule, verdict = free_name(df, "host", "path", "rule", "verdict")
    given: dict[UrlRule, int] = {}
    for k, r in enumerate(rules):
        given.setdefault(r, k)
    ordered = sorted(given, key=lambda r: (len(r.name), len(r.host), r.verdict == "block", -given[r]))  # a later one wins
    rank = {r: k for k, r in enumerate(ordered)}

    def one_pass(chunk: list[UrlRule], first: bool):
        best: dict[str, UrlRule] = {}
        for r in chunk:
            key = canonical(r.host.translate(_LOWER).split(".")[::-1], r.path)
            if key not in best or rank[r] > rank[best[key]]:
                best[key] = r
        swept = sorted((k, rank[r]) for k, r in best.items())
        said = {rank[r]: (len(r.name), r.name, r.verdict) for r in chunk}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = [split_url(u) for u in b.column(b.schema.get_field_index(url)).to_pylist()]
                keys = []
                for row, (h, p) in enumerate(parts):
                    labels = h.split(".")[::-1]
                    keys += [(canonical(labels[:k], p), row) for k in range(1, len(labels) + 1)]
                keys.sort()
                won = [-1] * len(parts) if first else [-1 if x is None else x for x in b.column(b.num_columns - 1).to_pylist()]
                for row, k in sweep(keys, swept):
                    if k > won[row]:
                        won[row] = k
                if first:
                    names, verdicts, base = [None] * len(parts), [default] * len(parts), b.columns
                else:
                    names, verdicts, base = b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2).to_pylist(), b.columns[:-5]
                for row, k in enumerate(won):
                    if k in said:
                        _, names[row], verdicts[row] = said[k]
                yield pa.RecordBatch.from_arrays(
                    [*base, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array([None if k < 0 else k for k in won], pa.int64())], schema.names
                )

        return run

    [won] = free_name(df, "won")
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in (host, path, rule, verdict)), T.StructField(won, T.LongType())])
    out = df
    for k, chunk in enumerate(chunks(rules) or [[]]):
        out = out.mapInArrow(one_pass(chunk, k == 0), schema)
    return out.drop(won)
