"""Mixing sources to target weights by Pfair scheduling, DataFrame operations only.

Rows of a source, in a hashed order, form blocks of `block_rows`. In a fluid mixture all sources are
served at once by their weights, and when one runs out the others go on by their renormalised weights.
The j-th block of a source is released at the slot in which the fluid mixture begins it and due by the end
of that in which it ends it (floor((j-1)/w) and ceil(j/w) while all sources last); earliest deadline first
among released blocks meets all deadlines, so that at any slot each source deviates from its exact
share by less than one block. The driver lays out the schedule, a row to a block, and writes it in chunks; no row is dropped or repeated.
"""

from __future__ import annotations

import heapq
import itertools
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.llm.common import free_name, new_path

BLOCK_ROWS = 16
PERIOD = 1000
#: Rows of one window; a source of any size is split into hash ranges of about this many rows.
RANGE_ROWS = 4096
#: Blocks that the driver writes at once.
CHUNK = 1 << 18
#: Rows up to which a schedule is broadcast (48 bytes each); longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Slots of each source in a period, at least one: largest remainders, ties by name."""
    period = max(period, len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))
    k = 0
    while sum(out.values()) < period:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s], str(s)))] -= 1
    return out


def placed(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot, earliest deadline first among the released blocks."""
    order = sorted((k for k in range(len(blocks)) if blocks[k] > 0), key=lambda k: Fraction(blocks[k], weights[k]))
    ends = [blocks[k] / weights[k] for k in order]
    # Up to the k-th end, the fluid mixture has served gone[k] + rate[k] * v at the virtual time v.
    gone, rate = [0], [sum(weights[k] for k in order)]
    for k in order:
        gone.append(gone[-1] + blocks[k])
        rate.append(rate[-1] - weights[k])

    def served(j: int, w: int) -> tuple[int, int]:
        """j / w as a time: whole slots, and 1 if a part of one is left."""
        k = bisect_right(ends, j / w)
        while k < len(order) and blocks[order[k]] * w <= j * weights[order[k]]:
            k += 1
        while k and blocks[order[k - 1]] * w > j * weights[order[k - 1]]:
            k -= 1
        whole, rest = divmod(rate[k] * j, w)
        return gone[k] + whole, int(rest > 0)

    waiting = [(0, k) for k in sorted(order)]
    ready: list = []
    done = [0] * len(blocks)
    for t in range(gone[-1]):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (sum(served(done[k] + 1, weights[k])), k))
        _, k = heapq.heappop(ready)
        yield k, done[k]
        done[k] += 1
        if done[k] < blocks[k]:
            heapq.heappush(waiting, (served(done[k], weights[k])[0], k))


def edf(slots: dict) -> list:
    """One period: the source of each slot."""
    names = sorted(slots, key=str)
    numbers = [slots[s] for s in names]
    return [names[k] for k, _ in placed(numbers, numbers)]


def whole_weights(weights: list) -> list[int]:
    """Integers in the same proportions."""
    exact = list(map(Fraction, weights))
    common = math.lcm(*(w.denominator for w in exact))
    return [int(w * common) for w in exact]


def _scheduled(counts: DataFrame, named: dict | None, block_rows: int, period: int | None) -> DataFrame:
    """(q_source, q_block, q_slot), from the rows of each source; the driver holds the sources and one chunk of blocks."""
    spark = counts.sparkSession
    rows = dict(sorted((s, n) for s, n in counts.collect()))
    mean = sum(named.values()) / len(named) if named else Fraction(1)
    by = tempered(rows) if named is None else {s: named.get(s, mean) for s in rows}
    if period and rows:
        by = shares(by, period)
    names = list(rows)
    slots = enumerate(placed(whole_weights([by[s] for s in names]), [-(-rows[s] // block_rows) for s in names]))
    path = new_path(spark, "schedule")
    schema = pa.schema([("q_source", pa.string()), ("q_block", pa.int64()), ("q_slot", pa.int64())])
    while True:
        chunk = [(names[k], block, slot) for slot, (k, block) in itertools.islice(slots, CHUNK)]
        if chunk or not rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*chunk), schema.types)] if chunk else [pa.array([], t) for t in schema.types]
            spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema)).write.mode("append").parquet(path)
        if len(chunk) < CHUNK:
            return spark.read.schema("q_source string, q_block bigint, q_slot bigint").parquet(path)


def tempered(counts: dict, power: float = 0.7) -> dict:
    """Default target weights: rows to a power below one, which raises small sources."""
    return {s: Fraction(round(max(n, 1) ** power * 1000), 1000) for s, n in counts.items()}


def mixed(df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str | None = "text", weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int | None = None, seed: int = 5) -> DataFrame:
    """df with mix_block (number of the block in its source), mix_slot and mix_pos, which orders the mixture.

    weights: of each source (a null source is named None); sources not named get the mean of the named. Default: tempered().
    period: if given, weights are rounded to so many slots first; otherwise they hold exactly.
    Every row is placed once; rows that are equal in id and text are tied in any order. No rows give no rows.
    The new columns are named with leading underscores where df has such names already.
    """
    name, h, bucket, n, before, place = free_name(df, "source_key", "hash_key", "bucket", "n_rows", "before", "place")
    block, slot, pos = free_name(df, "mix_block", "mix_slot", "mix_pos")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    hashed = F.xxhash64(F.lit(seed), doc_id, *([text] if text else []))
    counted = df.groupBy(key.alias(name)).count()
    sources = counted.agg(F.count("*"), F.sum("count")).first()
    total = sources[1] or 0
    named = None if weights is None else {"n" if s is None else f"s{s}": Fraction(w) for s, w in weights.items()}
    if named and any(w <= 0 for w in named.values()):
        raise ValueError("weights must be positive")
    bits = max(0, math.ceil(math.log2(max(total, 1) / RANGE_ROWS)) if total > RANGE_ROWS else 0)
    keyed = df.withColumn(name, key).withColumn(h, hashed).withColumn(bucket, F.shiftrightunsigned(F.col(h), 64 - bits).cast("int") if bits else F.lit(0))
    ranges = df.select(key.alias(name), hashed.alias(h)).withColumn(bucket, F.shiftrightunsigned(F.col(h), 64 - bits).cast("int") if bits else F.lit(0)).groupBy(name, bucket).count()
    offsets = ranges.select(name, bucket, (F.sum("count").over(Window.partitionBy(name).orderBy(bucket)) - F.col("count")).alias(before))
    within = Window.partitionBy(name, bucket).orderBy(h, doc_id, *([F.xxhash64(text)] if text else []))
    q = _scheduled(counted, named, block_rows, period)
    if total // block_rows + sources[0] <= BROADCAST_ROWS:  # no more blocks than that
        q = F.broadcast(q)
    return (
        keyed.withColumn(place, F.row_number().over(within) - 1)
        .join(offsets, [name, bucket])
        .withColumn(place, F.col(place) + F.col(before))
        .withColumn(block, F.floor(F.col(place) / block_rows).cast("long"))
        .join(q, (F.col(name) == F.col("q_source")) & (F.col(block) == F.col("q_block")))
        .withColumn(slot, F.col("q_slot"))
        .withColumn(pos, F.col(slot) * block_rows + F.col(place) % block_rows)
        .select(*df.columns, block, slot, pos)
    )


def in_mixed_order(df: DataFrame, **options) -> DataFrame:
    """df's rows and columns, sorted by place in the mixture: written files follow it.

    Places are dense, so a row's partition follows from its place without sampling.
    """
    out = mixed(df, **options)
    pos = out.columns[-1]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, -(-(df.count() + BLOCK_ROWS * df.select(options.get("source", "source")).distinct().count()) // parts))
    place = F.least(F.floor(F.col(pos) / rows), F.lit(parts - 1)).cast("int")
    return out.repartitionById(parts, place).sortWithinPartitions(pos).select(*df.columns)
