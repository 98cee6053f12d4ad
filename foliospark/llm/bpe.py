"""Byte-level BPE encoding and decoding over whole texts, in Arrow batches.

A text is cut by the tokenizer's pattern; the distinct pieces of a batch that a worker
hasn't met are encoded together. They are bucketed by length into padded matrices of token
ids. Each round looks up the rank of every adjacent pair in a hash table, merges in every row
the leftmost pair of least rank, closes the gap, and drops finished rows from the matrix.
In rows over LONG symbols a round merges, left to right, every pair of that least rank, where
no merge makes a pair of lower rank: the rounds that would follow one by one.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import free_name

NONE = np.int32(2**31 - 1)
#: Symbols of a row above which a round merges more than one pair.
LONG = 64
#: Most cells of a matrix, and most bytes of pieces that a worker remembers.
CELLS, REMEMBERED = 1 << 18, 16 << 20


def shipped(df: DataFrame, path: str) -> None:
    """Sends the vocabulary's file to the executors of a cluster, which needn't have it at the driver's path."""
    context = df.sparkSession.sparkContext
    if not context.master.startswith("local"):
        context.addFile(path)


def _found(path: str) -> str:
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


class Ranks:
    """The vocabulary: bytes to ranks, and a hash table from pairs of ids to the rank of their join."""

    def __init__(self, path: str):
        with open(_found(path), "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {k: v for v, k in self.ids.items()}
        self.single = np.full(256, -1, np.int64)
        left, right, rank = [], [], []
        for token, k in self.ids.items():
            if len(token) == 1:
                self.single[token[0]] = k
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(k)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        # Open addressing with linear probing, at most a quarter full.
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(self.mask + 1, 2**64 - 1, np.uint64)
        self.ranks = np.full(self.mask + 1, NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 1
        ranks = np.array(rank, np.int32)
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = keys[todo[put]], ranks[todo[put]]
            todo, at = todo[~put], (at[~put] + 1) & self.mask
            self.probes += bool(len(todo))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the joins of the pairs (a, b), NONE where there is none; negative ids have none."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        at = at.reshape(-1)[open_]
        flat, wanted, out = keys.reshape(-1)[open_], keys.reshape(-1), out.reshape(-1)
        while len(open_):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == flat
            out[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (found != np.uint64(2**64 - 1))
            open_, at, flat = open_[go], at[go], flat[go]
        out = out.reshape(a.shape)
        return np.where((a < 0) | (b < 0), NONE, out)


def _merge_rows(ids: np.ndarray, ranks: Ranks) -> list[np.ndarray]:
    """Rows of ids padded with -1, merged to the end, one pair a row and round."""
    out: list = [None] * len(ids)
    rows = np.arange(len(ids))
    pair = ranks.look_up(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NONE)
    while len(rows):
        at = pair.argmin(axis=1)
        least = pair[np.arange(len(rows)), at]
        done = least == NONE
        if done.any():
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k][ids[k] >= 0]
            rows, ids, pair, at, least = rows[~done], ids[~done], pair[~done], at[~done], least[~done]
            if not len(rows):
                break
        n, width = ids.shape
        r = np.arange(n)
        ids[r, at] = least
        cols = np.arange(width - 1)
        moved = cols[None, :] + (cols[None, :] > at[:, None])  # compaction: what lies right of the merge moves by one
        shorter = np.take_along_axis(ids, moved, axis=1)
        if width == 2:
            for k in range(n):
                out[rows[k]] = shorter[k][shorter[k] >= 0]
            break
        cut = np.arange(width - 2)
        pair = np.take_along_axis(pair, np.minimum(cut[None, :] + (cut[None, :] > at[:, None]), width - 2), axis=1)
        ids = shorter
        has = at < width - 2  # the two pairs beside the merge are looked up anew
        pair[r[has], at[has]] = ranks.look_up(ids[r[has], at[has]], ids[r[has], at[has] + 1])
        has = at > 0
        pair[r[has], at[has] - 1] = ranks.look_up(ids[r[has], at[has] - 1], ids[r[has], at[has]])
        used = (ids >= 0).sum(axis=1).max()
        if used < ids.shape[1]:
            ids, pair = ids[:, : max(used, 2)], pair[:, : max(used - 1, 1)]
    return out


def _merge_long(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """One long row: each round merges every pair of least rank, left to right, if that makes no pair of lower rank; else the leftmost alone."""
    while len(ids) > LONG:
        pair = ranks.look_up(ids[:-1], ids[1:])
        least = pair.min()
        if least == NONE:
            return ids
        at = np.flatnonzero(pair == least)
        run = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1))  # in a run of overlapping pairs every other one merges
        start = np.repeat(at[run], np.diff(np.append(run, len(at))))
        at = at[(at - start) % 2 == 0]
        new = np.full(len(at), least, ids.dtype)
        after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
        merged_before = np.concatenate(([False], at[1:] == at[:-1] + 2))
        before = np.where(merged_before, least, before)
        if (ranks.look_up(new, after) < least).any() or (ranks.look_up(before, new) < least).any():
            at = at[:1]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids = ids.copy()
        ids[at] = least
        ids = ids[keep]
    return _merge_rows(ids[None, :].copy(), ranks)[0]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Token ids of each piece."""
    out: list = [None] * len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    order = np.argsort(lengths, kind="stable")
    bounds = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, LONG]
    begin = int(np.searchsorted(lengths[order], 0, side="right"))
    for k in order[:begin]:
        out[k] = np.zeros(0, np.int64)
    for bound in bounds:
        end = int(np.searchsorted(lengths[order], bound, side="right"))
        for at in range(begin, end, max(1, CELLS // bound)):
            which = order[at : min(end, at + max(1, CELLS // bound))]
            width = max(2, int(lengths[which].max()))
            flat = np.frombuffer(b"".join(pieces[k] for k in which), np.uint8)
            n = lengths[which]
            inside = np.arange(width)[None, :] < n[:, None]
            ids = np.full((len(which), width), -1, np.int64)
            ids[inside] = ranks.single[flat]
            for k, row in zip(which, _merge_rows(ids, ranks)):
                out[k] = row
        begin = end
    for k in order[begin:]:
        out[k] = _merge_long(ranks.single[np.frombuffer(pieces[k], np.uint8)], ranks)
    return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks, self.find = Ranks(path), regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.size = 0

    def encode(self, texts: list[str | None]) -> list[array]:
        """Ids of each text; null texts have none."""
        cut = [self.find(t) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(cut)) - self.known.keys())
        if self.size > REMEMBERED:
            self.known, self.size = {}, 0
            fresh = list(set(chain.from_iterable(cut)))
        self.known.update(zip(fresh, (tuple(x.tolist()) for x in encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh], self.ranks))))
        self.size += sum(map(len, fresh)) + 100 * len(fresh)
        of = self.known.__getitem__
        return [array("I", chain.from_iterable(map(of, pieces))) for pieces in cut]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.ranks.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _little_endian(ids: array) -> bytes:
    return np.frombuffer(ids, np.uintc).astype("<u4").tobytes() if len(ids) else b""


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep: list[str] | None = None, check: str | None = None) -> DataFrame:
    """df (or its columns `keep`) with the token ids of each text, array<int>. Null and empty texts have none.

    New columns are underscored where those kept have such names. Repeated rows give a row each; no rows give none.
    check: name of one more column, whether the ids decode to the text's bytes again, told in the same pass.
    """
    shipped(df, path)
    keep = list(df.columns) if keep is None else keep
    kept = df.select(*keep)
    [out] = free_name(kept, out)
    if check:
        out, check = free_name(kept, out, check)
    [work] = free_name(df, "work")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in _small(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            ids = e.encode(texts)
            more = [pa.array([e.decode(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)])] if check else []
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype(np.int32))
            flat = pa.array(np.concatenate([np.frombuffer(x, np.uintc).astype(np.int32) for x in ids if len(x)] or [np.zeros(0, np.int32)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, flat), *more], schema.names)

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])])
    return df.select(*keep, F.col(text).alias(work)).mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "text_bytes") -> DataFrame:
    """df with the bytes that its token ids stand for (underscored where df has that name). Null ids give null; repeated rows give a row each."""
    shipped(df, path)
    [out] = free_name(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, "").ranks.bytes.__getitem__
        for b in _small(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else b"".join(map(of, x)) for x in b.column(ids).to_pylist()], pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def _small(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few MB, so that a worker holds few texts at once."""
    for b in batches:
        step = max(1, int(b.num_rows * most / max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of df: doc_id, n_tokens, and digests of the ids and of the bytes decoded from them.

    Null texts count as empty; repeated rows give a row each; no rows give none. Other columns are ignored.
    """
    shipped(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in _small(batches):
            ids = e.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(_little_endian(x)).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
