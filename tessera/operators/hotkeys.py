"""Per-key results when a few keys hold most rows.

Every input split is dictionary-encoded on its own and reduced with numpy
``bincount`` into dense accumulator arrays (one slot per local key), so a
task's cost follows its rows, not how they spread over keys.  The arrays
leave a split in blocks chosen by key hash: a block is one row holding an array
of keys and one array per accumulator.  Blocks of equal number meet and are
summed as arrays, by encoding their keys and a scatter-add; a split sends each
key once per flush, whatever its number of rows.  No global dictionary is built
or broadcast, so the number of keys is unbounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def _bincount(codes: np.ndarray, n: int, weights: np.ndarray | None) -> np.ndarray:
    if weights is None:
        return np.bincount(codes, minlength=n).astype(np.int64)
    if np.issubdtype(weights.dtype, np.integer):  # float sums lose exactness beyond 2**53
        out = np.zeros(n, np.int64)
        np.add.at(out, codes, weights)
        return out
    return np.bincount(codes, weights=weights, minlength=n)


def accumulate(df: DataFrame, key: str, sums: list[str] | None = None, blocks: int = 4096, flush: int = 65536) -> DataFrame:
    """``key``, ``n_rows`` and a sum of each column of ``sums``, per key.

    Integer columns sum exactly as bigint (sums must fit), others as double; nulls add nothing,
    so a key with only null values has sum 0.  The null key is a key of its
    own.  An empty table gives no rows.  ``flush`` bounds the keys a task
    holds; beyond it partial arrays are sent on early.  ``blocks`` is the
    number of hash blocks of keys; a block's arrays meet in one task.
    """
    sums = sums or []
    kinds = {c: ("bigint" if df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double") for c in sums}
    src = df.select(F.col(f"`{key}`").alias("_key"), *[F.coalesce(F.col(f"`{c}`").cast(kinds[c]), F.lit(0).cast(kinds[c])).alias(f"_s{i}") for i, c in enumerate(sums)])
    key_type = src.schema["_key"].dataType.simpleString()
    names = ["_n", *[f"_s{i}" for i in range(len(sums))]]
    types = ["bigint", *[kinds[c] for c in sums]]
    schema = f"_key {key_type}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types))
    arrays_of = f"block int, _key array<{key_type}>, " + ", ".join(f"{n} array<{t}>" for n, t in zip(names, types))

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        arrays = [np.zeros(1024, np.int64 if t == "bigint" else np.float64) for t in types]
        kind = None

        def out() -> pa.RecordBatch:
            block = np.fromiter((zlib.crc32(repr(k).encode()) % blocks for k in held), np.int32, len(held))
            order = pa.array(np.argsort(block, kind="stable"))
            block = np.sort(block)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            offs = pa.array(np.append(first, len(block)).astype(np.int32))
            cols = [pa.array(list(held), kind), *[pa.array(a[: len(held)]) for a in arrays]]
            return pa.RecordBatch.from_arrays([pa.array(block[first]), *[pa.ListArray.from_arrays(offs, c.take(order)) for c in cols]], names=["block", "_key", *names])

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.column(0).type
            enc = b.column(0).dictionary_encode(null_encoding="encode")
            words = enc.dictionary.to_pylist()
            codes = enc.indices.to_numpy(zero_copy_only=False)
            slot = np.fromiter((held.setdefault(w, len(held)) for w in words), np.int64, len(words))
            while len(held) > len(arrays[0]):
                arrays = [np.concatenate([a, np.zeros_like(a)]) for a in arrays]
            for i, a in enumerate(arrays):
                w = None if i == 0 else b.column(i).to_numpy(zero_copy_only=False)
                a[slot] += _bincount(codes, len(words), w).astype(a.dtype)
            if len(held) >= flush:
                yield out()
                held, arrays = {}, [np.zeros_like(a[:1024]) for a in arrays]
        if held:
            yield out()

    def total_of(t: pa.Table) -> pa.Table:
        cols = [t.column(c).combine_chunks().flatten() for c in ("_key", *names)]
        enc = cols[0].dictionary_encode(null_encoding="encode")
        codes, m = enc.indices.to_numpy(zero_copy_only=False), len(enc.dictionary)
        return pa.Table.from_arrays([enc.dictionary, *[pa.array(_bincount(codes, m, c.to_numpy(zero_copy_only=False))) for c in cols[1:]]], names=["_key", *names])

    # one row per split (and flush) and block, summed array by array
    total = src.mapInArrow(splits, arrays_of).groupBy("block").applyInArrow(total_of, schema)
    return total.select(F.col("_key").alias(key), F.col("_n").alias("n_rows"), *[F.col(f"_s{i}").alias(f"sum_{c}") for i, c in enumerate(sums)])
