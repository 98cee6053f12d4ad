"""SimHash near-dedup by the generalised pigeonhole principle.

64-bit fingerprints are linked at Hamming distance <= tau. Correlated bits are grouped
into m partitions; thresholds t_1..t_m with sum tau - m + 1 are allocated by dynamic
programming on estimated candidate counts (-1 leaves a partition out): two fingerprints
within tau agree on some partition i up to t_i bits. A threshold t becomes one masked
key per choice of t ignored bits, so that candidates meet by equality; then they are
verified in numpy. Every statistic is taken over all distinct fingerprints.

Only distinct fingerprints are compared: exact copies collapse in a map-side aggregate.
A key shared by more than BLOCK fingerprints is dealt out as pairs of blocks, so no task
holds an unbounded group, and a task emits a spanning forest of the links that it
found, never all pairs.

Two ways to use it: near_duplicates() links 64-bit fingerprints of shingles at a few differing
bits. near_copies() finds texts whose sets of shingles are similar (0.8, five words): at that
similarity fingerprints of shingles differ in a sixth of their bits, too many to probe 64 bits for.
So fingerprints have 1024 bits, and texts meet that agree on one of many masked keys of theirs, whatever
was replaced, cut or appended; differing bits leave loose groups, and within these the sets of shingles
themselves are compared, so that a link is an exact similarity.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import dropped, free_name, written
from foliospark.llm.components import connected_components

SEED = 42
#: Most fingerprints that one key brings together in one block, while that takes no more than MOST_BLOCKS blocks; blocks of more hold up to BLOCK_BYTES.
BLOCK, MOST_BLOCKS, BLOCK_BYTES = 4096, 64, 32 << 20
#: The same for the texts of a loose group, where their sets of shingles are compared.
EXACT_BLOCK = 512
#: Hot keys up to this number (16 bytes each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_KEYS = 20_000
#: Cost of one emitted key against one verified pair.
KEY_COST = 40.0
#: 64-bit words of the fingerprints that near_copies() verifies.
SKETCH_WIDTH = 16
#: Of these, the words that a probe carries where the sets of shingles are compared afterwards.
LOOSE_WIDTH = 4
#: Keys of BAND_BITS bits of a wide fingerprint that near_copies() probes. Bits differ with p = 0.15 at a similarity of 0.8 and all keys differ for about 1 - 2 pairs in 10,000.
#: Sets of at most FEW hashes, whose fingerprints differ in more bits (0.19 for 4 of 5), have twice as many keys.
BANDS, BAND_BITS, FEW = 96, 14, 16


def _masks() -> np.ndarray:
    """2 * BANDS x BAND_BITS: places of bits. Permutations of all bits are cut into keys, so that none of a permutation shares a bit with another."""
    rng, keys = np.random.default_rng(SEED), []
    while len(keys) < 2 * BANDS:
        keys += list(rng.permutation(64 * SKETCH_WIDTH)[: 64 * SKETCH_WIDTH // BAND_BITS * BAND_BITS].reshape(-1, BAND_BITS))
    return np.array(keys[: 2 * BANDS])


_BAND_PLACES = _masks()


def shingle_hashes(text: str | None, words: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a whole text, in order; of the whole sequence where it is shorter."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, n)
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1
    )


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; none: 0."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority of the bits of XXH64 (seed 42) over the word shingles of a whole text; no words: 0."""
    return majority(shingle_hashes(text, words))


def wide_fingerprint(hashes: np.ndarray, width: int) -> np.ndarray:
    """width signed words of 64 bits over the set of hashes, each from another mixing of them; no hashes: zeros."""
    distinct = np.unique(hashes)
    salts = np.array([(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(width)], np.uint64)
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, len(distinct), 255):  # so few rows that a byte holds a sum
        x = distinct[at : at + 255, None] + salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(distinct), bitorder="little").view("<i8")


def band_keys(wide: np.ndarray, n: int = FEW + 1) -> np.ndarray:
    """BANDS keys (twice as many for few hashes, n) of a wide fingerprint, each some of its bits: two that differ in a share p of their bits agree on one with the probability (1 - p) ** BAND_BITS."""
    bits = np.unpackbits(wide.astype("<i8").view(np.uint8), bitorder="little")
    return bits[_BAND_PLACES[: BANDS if n > FEW else 2 * BANDS]] @ (1 << np.arange(BAND_BITS, dtype=np.int64))


def differing_bits(similarity: float, width: int = SKETCH_WIDTH) -> int:
    """Bits in which wide fingerprints of sets of that Jaccard similarity differ, and one standard deviation more."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(64 * width * p + math.sqrt(64 * width * p * (1 - p)))


def loose_bits(similarity: float, width: int = LOOSE_WIDTH) -> int:
    """Bits within which pairs of that similarity stay, of sets of a few hashes too, whose fingerprints differ in up to a quarter more."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(64 * width * p * 1.25 + 4 * math.sqrt(64 * width * p * (1 - p)))


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 4) -> DataFrame:
    """Adds the signed 64-bit fingerprint. Null and empty texts give 0."""

    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out, fingerprints(F.col(text)))


def hex_of(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


# ---- plan: bit groups and thresholds ----


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    together = np.zeros((64, 64))
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for at in range(0, len(values), 1 << 14):
            bits = np.unpackbits(values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
    i, j = np.triu_indices(64)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(together[i, j].astype(np.int64))], ["i", "j", "n"])


def bit_statistics(nodes: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set. 2,080 sums reach the driver."""
    out = np.zeros((64, 64))
    counted = nodes.select("fp").mapInArrow(_bit_counts, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r.i, r.j] = out[r.j, r.i] = r.n
    return out


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of (nearly) equal width, each grown by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for g in range(m):
        width = math.ceil(len(left) / (m - g))
        rest = sorted(left)
        group = [max(rest, key=lambda b: corr[b, rest].sum())]
        left.discard(group[0])
        while len(group) < width:
            best = max(sorted(left), key=lambda b: corr[b, group].mean())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> list[int]:
    """Thresholds with the given sum and the least cost, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for (s, (c, chosen)), (t, cost) in itertools.product(best.items(), options.items()):
            if s + t not in step or c + cost < step[s + t][0]:
                step[s + t] = (c + cost, [*chosen, t])
        best = step
    return best[total][1]


def masks_of(groups: list[list[int]], thresholds: list[int]) -> list[int]:
    """Unsigned masks: of each group, all bits but one choice of as many as its threshold."""
    return [sum(1 << b for b in group if b not in out) for group, t in zip(groups, thresholds) if t >= 0 for out in itertools.combinations(group, t)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan_masks(nodes: DataFrame, n: int, tau: int) -> list[int]:
    together = bit_statistics(nodes)
    # One exact part should hold about as many values as there are fingerprints: fewer, wider parts for more rows.
    m = max(1, min(tau + 1, 64 // max(13, min(32, math.ceil(math.log2(max(n, 2)) * 0.85)))))
    groups = group_bits(together, n, m)
    keyed = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(sum(1 << b for b in g)))).alias("key")) for k, g in enumerate(groups)])).alias("x")).select("x.*")
    pairs = {r.part: float(r.pairs or 0) for r in keyed.groupBy("part", "key").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    ratio = differ / np.maximum(1 - differ, 1e-9)
    total, costs = tau - m + 1, []
    for k, group in enumerate(groups):
        options = {-1: 0.0}
        for t in range(0, min(total + m - 1, len(group)) + 1):
            mean = float(np.mean(ratio[group]))
            agree = pairs.get(k, 0.0) * (1 + mean) ** t
            options[t] = math.comb(len(group), t) * (agree + KEY_COST * n)
        costs.append(options)
    return masks_of(groups, allocate(costs, total))


# ---- probe and verify ----


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of n points under the links a-b, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits, row by row; a row is one word or several."""
    bits = np.bitwise_count(x ^ y)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int32)


def _search(fps: np.ndarray, tau: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links within one large group, breadth first: what is reached is never compared with itself."""
    left = np.arange(len(fps))
    parents, children = [], []
    while len(left) > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _apart(fps[left], fps[at]) <= tau
            if near.any():
                found = left[near]
                parents.append(np.full(len(found), at))
                children.append(found)
                frontier.extend(found.tolist())
                left = left[~near]
    return parents, children


def verify_sorted(cells: np.ndarray, fps: np.ndarray, ids: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (id, id) within runs of equal cells. cells: run numbers in order; fps: a word each, or rows of words."""
    n = len(cells)
    if n < 2:
        return ids[:0], ids[:0]
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.append(starts, n))
    a_all, b_all = [], []
    long = np.flatnonzero(sizes > 64)
    small = np.ones(n, bool)
    for k in long:
        s, e = starts[k], starts[k] + sizes[k]
        small[s:e] = False
        p, c = _search(fps[s:e], tau)
        a_all += [x + s for x in p]
        b_all += [x + s for x in c]
    rest = np.flatnonzero(small)
    if len(rest):
        room = (np.repeat(starts + sizes, sizes))[rest]  # end of the run
        d, active = 1, rest
        while True:
            keep = active + d < room
            active, room = active[keep], room[keep]
            if not len(active):
                break
            near = _apart(fps[active], fps[active + d]) <= tau
            a_all.append(active[near])
            b_all.append(active[near] + d)
            d += 1
    if not a_all:
        return ids[:0], ids[:0]
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    if not len(a):
        return ids[:0], ids[:0]
    label = _roots(n, a, b)
    child = np.flatnonzero(label != np.arange(n))
    return ids[label[child]], ids[child]


def _verify(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def links(columns: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(len(columns[0]), bool)
            for c in columns[:3]:
                change[1:] |= c[1:] != c[:-1]
            fps = columns[3].view(np.uint64) if len(columns) == 5 else np.stack(columns[3:-1], axis=1).view(np.uint64)
            u, v = verify_sorted(np.cumsum(change), fps, columns[-1], tau)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            now = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False).astype(np.int64)) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            n = len(now[0])
            if not n:
                continue
            same = np.ones(n, bool)
            for c in now[:3]:
                same &= c == c[-1]
            cut = n - int(np.argmin(same[::-1])) if not same.all() else 0  # the last run may go on in the next batch
            if cut:
                yield links([c[:cut] for c in now])
            held = [c[cut:] for c in now]
        if held is not None and len(held[0]) > 1:
            yield links(held)

    return run


def with_cells(rows: DataFrame, keys: list[str], by: list[str], block: int, size: Column) -> DataFrame:
    """rows with a cell each: 0, but a key of over `block` rows, or of more bytes (size: those of a row) than a block holds, is dealt out as pairs of blocks, by a hash of `by`, so that any two of its rows meet in a cell.

    A row goes to each pair that its block is in, so a key has MOST_BLOCKS blocks at most, and more only where these would hold more than BLOCK_BYTES.
    """
    n, held = F.col("n_rows"), F.col("n_bytes")
    needed = F.greatest(F.least(F.ceil(n / block), F.lit(MOST_BLOCKS)), F.ceil(held / BLOCK_BYTES)).cast("long")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(size.cast("long")).alias("n_bytes"))
    hot = written(counts.where((n > block) | (n > 1) & (held > BLOCK_BYTES)).select(*keys, needed.alias("blocks")), "hotkeys")
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumn("cell", F.lit(0))
    return (
        rows.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, keys, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(*by), F.col("blocks")))
        .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        .withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    )


def near_links(nodes: DataFrame, tau: int = 4, verified: tuple[str, ...] = ("fp",), bands: str | None = None) -> DataFrame:
    """(u, v): a spanning forest, task by task, of the links among distinct fingerprints; nodes: fp, rep (none null).

    Rows meet that differ in at most tau bits of fp or, where a column of keys is named (bands), agree on one of these; they link at no more than tau differing bits in all columns verified.
    """
    if bands:
        keys = F.transform(bands, lambda x, k: F.struct(k.cast("int").alias("mask"), x.alias("key")))
    else:
        masks = plan_masks(nodes.select("fp"), nodes.count(), tau)
        keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(x))).alias("key")) for k, x in enumerate(masks)])
    probes = nodes.select(*verified, "rep", F.explode(keys).alias("x")).select("x.mask", "x.key", *verified, "rep")
    probes = with_cells(probes, ["mask", "key"], list(verified), BLOCK, F.lit(8 * len(verified) + 8))
    dealt = probes.select("mask", "key", "cell", *verified, "rep").repartition("mask", "key", "cell").sortWithinPartitions("mask", "key", "cell")
    return dealt.mapInArrow(_verify(tau), "u bigint, v bigint")


def _numeric(df: DataFrame, doc_id: str) -> None:
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise ValueError(f"{doc_id} must be a column of integers")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 4, words: int = 4) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most tau differing bits.
    Null and empty texts have fingerprint zero and link like any other. Rows whose doc_id
    is null link too, but can't name a component: it is null if no other row is in it.
    Repeated rows and ids give a row each; no rows give no rows. Other columns are ignored.
    Ids are numbers (ValueError otherwise). A larger tau stays exact and probes more keys.
    """
    _numeric(df, doc_id)
    fps = written(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), out="fp", words=words).select("doc_id", "fp"), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    linkable = nodes.where("rep is not null").select("fp", F.col("rep").cast("bigint").alias("rep"))
    if nodes.where("rep is null").limit(1).count():
        # Fingerprints with no id at all still bridge others: they get keys above every id, hidden again below.
        top = nodes.agg(F.max("rep")).first()[0] or 0
        linkable = written(nodes.select("fp", F.coalesce(F.col("rep").cast("bigint"), F.lit(int(top) + 1) + F.shiftrightunsigned(F.xxhash64("fp"), 2)).alias("rep")), "nodes")
        hidden = int(top)
    else:
        hidden = None
    near = written(near_links(linkable, tau), "near")
    parts = connected_components(near)
    dropped(near)
    part = F.coalesce(F.col("component"), F.col("rep"))
    named = linkable.join(parts.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", (part if hidden is None else F.when(part <= hidden, part)).alias("component_id"))
    return fps.join(named.hint("merge"), "fp").select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def with_wide_fingerprints(df: DataFrame, text: str, words: int, sketch: list[str], bands: str) -> DataFrame:
    """Adds the wide fingerprint of the set of shingles of a text, a column to a word, and its keys."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def both(texts: pd.Series) -> pd.Series:
        hashes = (np.unique(shingle_hashes(t, words)) for t in texts)
        return pd.Series([np.concatenate((wide := wide_fingerprint(h, len(sketch)), band_keys(wide, len(h)))) for h in hashes], dtype=object)

    [work] = free_name(df, "work")
    out = df.withColumn(work, both(F.col(text)))
    return out.select(*df.columns, *(F.get(work, F.lit(k)).alias(c) for k, c in enumerate(sketch)), F.slice(work, len(sketch) + 1, 2 * BANDS).alias(bands))


def similar_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of the links between sets of hashes at a Jaccard similarity or more, breadth first; sets: distinct hashes each."""
    sizes = np.array([len(x) for x in sets], np.int64)
    left = np.flatnonzero(sizes)
    parents, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(left) > 1:
        known, flat = np.unique(np.concatenate([sets[k] for k in left]), return_inverse=True)
        own = dict(zip(left.tolist(), np.split(flat, np.cumsum(sizes[left])[:-1])))
        starts = np.cumsum(sizes[left]) - sizes[left]
    while len(left) > 1:
        frontier = [int(left[0])]
        inside = np.ones(len(left), bool)
        inside[0] = False
        while frontier and inside.any():
            at = frontier.pop()
            marked = np.zeros(len(known), bool)
            marked[own[at]] = True
            common = np.add.reduceat(marked[flat], starts, dtype=np.int64)
            near = inside & (common * (1 + similarity) >= similarity * (sizes[left] + sizes[at]) - 1e-9)
            if near.any():
                found = left[near]
                parents.append(np.full(len(found), at))
                children.append(found)
                frontier.extend(found.tolist())
                inside &= ~near
                if inside.sum() * 2 < len(inside):
                    left = left[inside]
                    inside = np.ones(len(left), bool)
                    if len(left):
                        flat = np.concatenate([own[k] for k in left.tolist()])
                        starts = np.cumsum(sizes[left]) - sizes[left]
        left = left[inside]
        if len(left):
            flat = np.concatenate([own[k] for k in left.tolist()])
            starts = np.cumsum(sizes[left]) - sizes[left]
    return np.concatenate(parents), np.concatenate(children)


def _compare(words: int, similarity: float):
    """Rows (group, cell, rep, text) in order; a run of one group and cell is compared at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            u, v = similar_sets(sets, similarity)
            reps = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(reps[u]), pa.array(reps[v])], ["u", "v"])

        for batch in batches:
            for group, cell, rep, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, cell) != at:
                    if len(ids) > 1:
                        yield links()
                    at, ids, sets = (group, cell), [], []
                ids.append(rep)
                sets.append(np.unique(shingle_hashes(text, words)))
        if len(ids) > 1:
            yield links()

    return run


def exact_links(rows: DataFrame, nodes: DataFrame, loose: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): a spanning forest, task by task, of the links at an exact similarity within the loose groups (node, component); rows: doc_id, text, t."""
    members = nodes.join(loose.hint("merge"), F.col("rep") == F.col("node")).select(F.col("component").alias("group"), "rep", F.col("one.doc_id").alias("of"), F.col("one.t").alias("t"))
    # Only a text of each member moves on, and is hashed again where it is compared.
    texts = rows.join(members.hint("merge"), (rows["t"] == members["t"]) & rows["doc_id"].eqNullSafe(members["of"])).select("group", "rep", "text")
    celled = with_cells(written(texts, "members"), ["group"], ["rep"], EXACT_BLOCK, F.coalesce(F.octet_length("text"), F.lit(0)))
    dealt = celled.select("group", "cell", "rep", "text").repartition("group", "cell").sortWithinPartitions("group", "cell")
    return dealt.mapInArrow(_compare(words, similarity), "u bigint, v bigint")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """One row per row of df: doc_id, component_id, the smallest doc_id reachable over links between similar texts.

    exact: texts link if their sets of shingles (64-bit hashes) have at least that Jaccard similarity; pairs
    whose wide fingerprints agree on no key are missed, 1 - 2 in 10,000 of those at 0.8. Otherwise they link if their wide
    fingerprints differ in at most differing_bits(similarity): the share of common shingles is
    estimated, with a standard deviation of 0.02. Null and empty texts are equal. Rows whose doc_id is null link too, but can't name a component: it is null if no
    other row is in it. Repeated rows give a row each; no rows give no rows. Other columns are ignored.
    Ids are numbers (ValueError otherwise).
    """
    return _grouped_copies(df, doc_id, text, words, similarity, exact).select("doc_id", "component_id")


def _grouped_copies(df: DataFrame, doc_id: str, text: str, words: int, similarity: float, exact: bool) -> DataFrame:
    """doc_id, t (a hash of the text) and component_id of each row."""
    _numeric(df, doc_id)
    sketch = [f"s{k}" for k in range(SKETCH_WIDTH)]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("t"))
    marked = written(with_wide_fingerprints(rows, "text", words, sketch, "bands").drop("text"), "fingerprints")
    top = int(marked.agg(F.max("doc_id")).first()[0] or 0)
    grouped = marked.groupBy(*sketch).agg(F.min("doc_id").cast("bigint").alias("rep"), F.min("bands").alias("bands"), F.min(F.struct("doc_id", "t")).alias("one"))
    nameless = F.lit(top + 1) + F.shiftrightunsigned(F.xxhash64(*sketch), 2)
    nodes = written(grouped.select(*sketch, "bands", "one", F.coalesce("rep", nameless).alias("rep")), "nodes")
    links = near_links(nodes, loose_bits(similarity), tuple(sketch[:LOOSE_WIDTH]), "bands") if exact else near_links(nodes, differing_bits(similarity), tuple(sketch), "bands")
    if exact:
        loose = written(links, "loose")
        links = exact_links(rows, nodes, connected_components(loose), words, similarity)
        dropped(loose)
    near = written(links, "near")
    parts = connected_components(near)
    dropped(near)
    part = F.coalesce(F.col("component"), F.col("rep"))
    named = nodes.join(parts.hint("merge"), F.col("rep") == F.col("node"), "left").select(*sketch, F.when(part <= top, part).alias("component_id"))
    return marked.join(named.hint("merge"), sketch).select("doc_id", "t", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without near copies: of each group the row of its smallest doc_id, with all columns of df.

    Of repeated rows with that id one stays, by the order of a hash of their text. Rows without an id are kept if their whole group has none.
    """
    key, mark = free_name(df, "key", "mark")
    groups = _grouped_copies(df, doc_id, text, words, similarity, exact=True)
    # Rows without an id are told apart by their text.
    chosen = groups.where("component_id is null or doc_id = component_id").select(F.col("doc_id").alias(key), F.when(F.col("doc_id").isNull(), F.col("t")).alias(mark)).distinct()
    own = F.when(F.col(doc_id).isNull(), F.xxhash64(text))
    kept = df.join(chosen.hint("merge"), F.col(doc_id).eqNullSafe(F.col(key)) & own.eqNullSafe(F.col(mark)), "left_semi")
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    first = kept.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
    return first.unionByName(kept.where(F.col(doc_id).isNull()))
