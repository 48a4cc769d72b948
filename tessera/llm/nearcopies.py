"""Near-duplicate sequences by token-combination prefixes.

A record is the set of its distinct k-letter pieces (tokens).  Tokens fall into
classes by their frequency over the whole collection: a rare token is indexed
alone, a normal one in pairs, a frequent one in triples and a hot one (such as
an adapter a third of all reads carry) not at all, so no posting list of the
index follows the most common tokens.

Which combinations a record indexes is decided by extending its prefix just as
far as the threshold needs.  Token hashes are leaves of a binary trie whose
nodes are split in one fixed order; a record splits until its cost (one per
cell of normal tokens, up to two per cell of frequent tokens, one per hot
token) has reached the least overlap ``o - 1`` any partner needs.  Two records with ``o`` common
tokens then share a rare token, two normal tokens of a cell or three frequent
tokens of a cell, because more common tokens exist than the cells can hold
apart.  Splitting in one fixed order makes the cells of any two records nested,
so both index the shared combination: no similar pair is missed.  Candidates
that share too few combinations for their sizes are discarded by count, the
others verified exactly on the whole sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera.storage import discard, stage

SLOTS = 1 << 18  # hashed token counts: a fixed size, whatever the collection
BROADCAST_BYTES = 8 << 20  # most bytes of a side sent to all tasks
RARE, FREQUENT, HOT = 0.02, 8.0, 64.0  # class limits in mean counts of a slot
ROWS = 65_536  # most records in a block of the index; row numbers take 16 bits
PORTION = 640 << 10  # packed bytes of sequences whose tokens are made at a time
PER_BLOCK = 4_000_000  # combinations after which a block of the index is closed
SPARE = 3  # combinations similar records share beyond the first, for the count filter
PER_BUCKET = 2_000_000  # combinations one bucket should hold
MEETINGS = 1 << 20  # meetings in posting lists counted at a time
SIZED_BY = 64  # one record in so many is indexed beforehand to size the buckets
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of integers (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens(buf: np.ndarray, offs: np.ndarray, k: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token hashes of every record, sorted within it, and the records' offsets.

    Pieces of bytes are hashed by position-weighted sums and mixed to 32 bits;
    records shorter than ``k`` have none.
    """
    n = len(buf) - k + 1
    rows = len(offs) - 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    wide = buf.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key *= np.uint64(257)
        key += wide[j : n + j]
    lens = np.maximum(np.diff(offs) - k + 1, 0)
    start = np.repeat(offs[:-1], lens) if lens.sum() else np.zeros(0, np.int64)
    first = np.cumsum(lens) - lens
    at = start + np.arange(lens.sum()) - np.repeat(first, lens)
    owner = np.repeat(np.arange(rows, dtype=np.uint64), lens)
    h = _scramble(key[at] * _MIX + np.repeat(salt.astype(np.uint64), lens)) >> np.uint64(32)
    code = np.sort((owner << np.uint64(32)) | h)
    keep = np.ones(len(code), bool)
    keep[1:] = code[1:] != code[:-1]
    code = code[keep]
    return (code & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(code, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))


def _nodes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heap index of the trie node that separates two adjacent hashes."""
    diff = (a ^ b).astype(np.float64)
    depth = 32 - np.frexp(diff)[1]  # leading bits in common
    return (np.int64(1) << depth) | (a.astype(np.int64) >> (32 - depth))


def _joined(o: np.ndarray, near: np.ndarray, node: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Cell number of every token: a token opens a cell if its record splits the node before it."""
    same = np.zeros(len(o), bool)
    same[near + 1] = node >= limit[o[near]]
    return np.cumsum(~same)


def _subsets(x: np.ndarray, o: np.ndarray, cell: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures of all pairs or triples of tokens within the cells."""
    wide, live, d = x.astype(np.uint64), np.arange(len(x)), 1
    while len(live):
        live = live[live + d < len(x)]
        live = live[cell[live + d] == cell[live]]
        if size == 2:
            yield _scramble((wide[live] << np.uint64(32)) | wide[live + d]), o[live]
        else:
            for m in range(1, d):
                yield _scramble(_scramble((wide[live] << np.uint64(32)) | wide[live + m]) + wide[live + d]), o[live]
        d += 1


def combinations(h: np.ndarray, offs: np.ndarray, cls: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and their record numbers, for sorted token hashes ``h`` of classes 1 to 4.

    ``overlap`` is the least number of common tokens a record needs with any
    partner.  Hot tokens (class 4) index nothing and cost one each; a record
    that has too many of them for that counts them as frequent, and then also
    indexes its other tokens unsplit, as any partner might.  See the module
    text for the guarantee.
    """
    rows = len(offs) - 1
    owner = np.repeat(np.arange(rows), np.diff(offs))
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    count = [np.bincount(owner[cls == c], minlength=rows) for c in range(5)]
    budget = overlap - 1
    crowded = count[4] + np.minimum(count[2], 1) + np.minimum(count[3], 2) > budget
    crowded &= count[4] > 0
    eff = np.where((cls == 4) & crowded[owner], 3, cls)
    budget = np.where(crowded, budget, budget - count[4])
    rare = cls == 1
    parts.append((_scramble(h[rare].astype(np.uint64) + _MIX), owner[rare]))
    cost = np.zeros(rows, np.int64)
    seps = []  # row, node, cost of splitting it
    groups = {}
    for c in (2, 3):
        idx = np.flatnonzero(eff == c)
        o, x = owner[idx], h[idx]
        cost += np.minimum(np.bincount(o, minlength=rows), c - 1)
        near = np.flatnonzero(o[1:] == o[:-1])
        node = _nodes(x[near], x[near + 1])
        if c == 2:
            inc = np.ones(len(near), np.int64)
        else:  # min(left, 2) + min(right, 2) - min(both, 2) tokens a split adds
            key = (o.astype(np.uint64) << np.uint64(32)) | x
            depth = np.frexp(node.astype(np.float64))[1] - 1
            width = np.int64(1) << (32 - depth)
            low = (o[near].astype(np.int64) << 32) + (node - (np.int64(1) << depth)) * width
            lo, mid, hi = (np.searchsorted(key, (low + step).astype(np.uint64)) for step in (0, width // 2, width))
            inc = np.minimum(mid - lo, 2) + np.minimum(hi - mid, 2) - np.minimum(hi - lo, 2)
        groups[c] = (x, o, near, node)
        seps.append((o[near], node, inc))
    row, node, inc = (np.concatenate(s) for s in zip(*seps))
    order = np.lexsort((node, row))
    row, node, inc = row[order], node[order], inc[order]
    cum = np.cumsum(inc)
    edge = np.searchsorted(row, np.arange(rows + 1))
    base = np.where(edge[:-1] > 0, cum[np.maximum(edge[:-1] - 1, 0)], 0) if len(cum) else np.zeros(rows, np.int64)
    over = cost[row] + cum - base[row] > budget[row] if len(row) else np.zeros(0, bool)
    limit = np.full(rows, np.iinfo(np.int64).max)  # the first node a record does not split
    np.minimum.at(limit, row[over], node[over])
    tiny = cost > budget  # too few tokens for combinations: every token alone as well
    lone = tiny[owner] & ~rare
    parts.append((_scramble(h[lone].astype(np.uint64) + _MIX), owner[lone]))
    x, o, near, node = groups[2]
    parts.extend(_subsets(x, o, _joined(o, near, node, np.where(crowded, 0, limit)), 2))
    x, o, near, node = groups[3]
    parts.extend(_subsets(x, o, _joined(o, near, node, limit), 3))
    if crowded.any():
        own = (cls == 3) & crowded[owner]
        parts.extend(_subsets(h[own], owner[own], owner[own], 3))
    return np.concatenate([s for s, _ in parts]), np.concatenate([w for _, w in parts])


def least_overlap(n: np.ndarray, shortest: np.ndarray, threshold: float) -> np.ndarray:
    """Common tokens a record of ``n`` needs with its smallest possible partner."""
    partner = np.maximum(np.ceil(threshold * n - 1e-9), np.minimum(shortest, n))
    return np.maximum(np.ceil(threshold / (1 + threshold) * (n + partner) - 1e-9), 1).astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch], *cols: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about :data:`PORTION` bytes in the columns, but a record at least."""
    for b in batches:
        size = np.cumsum(sum(pc.binary_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in cols))
        cut = np.flatnonzero(np.diff((size - 1) // PORTION)) + 1
        for x, y in zip([0, *cut], [*cut, b.num_rows]):
            yield b.slice(x, y - x)


def _steps(values: np.ndarray) -> bytes:
    """Values as runs of equal ones: differences of their values and of their starts."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])
    return zlib.compress(np.concatenate([np.diff(values[at], prepend=0), np.diff(at, prepend=0)]).astype(np.int64).tobytes(), 1)


def _at(raw: bytes, row: np.ndarray) -> np.ndarray:
    """Values of some rows of :func:`_steps`."""
    a = np.frombuffer(zlib.decompress(raw), np.int64)
    h = len(a) // 2
    return np.cumsum(a[:h])[np.searchsorted(np.cumsum(a[h:]), row, side="right") - 1]


def token_table(uniq: DataFrame, k: int) -> tuple[dict[int, np.ndarray], dict[int, int], dict[int, int]]:
    """Per field: class of every token slot, tokens of the shortest record, all tokens.

    Counts cover the whole collection; splits send dense arrays of a fixed size
    in blocks, which are summed by block.
    """
    width = SLOTS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        least: dict[int, int] = {}
        for b in _portions(batches, 2):
            field = b.column(0).to_numpy(zero_copy_only=False)
            h, offs = tokens(*packed_buffer(b.column(2)), k, field)
            n = np.diff(offs)
            owner = np.repeat(field, n)
            for f in np.unique(field):
                held[f] = held.get(f, 0) + np.bincount(h[owner == f] >> np.uint32(14), minlength=SLOTS)
                some = n[(field == f) & (n > 0)]
                if len(some):
                    least[f] = min(least.get(f, 1 << 60), int(some.min()))
        for f, a in held.items():
            cells = [zlib.compress(a[i : i + width].astype(np.int64).tobytes(), 1) for i in range(0, SLOTS, width)]
            m = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array([int(f)] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(cells, pa.binary()), pa.array([least.get(f, 1 << 60)] * m, pa.int64())], names=["field", "block", "cells", "least"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = reduce(np.add, (np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["cells"]))
        return pd.DataFrame({"field": pdf["field"][:1], "block": pdf["block"][:1], "cells": [zlib.compress(cells.tobytes(), 1)], "least": [pdf["least"].min()]})

    schema = "field int, block int, cells binary, least bigint"
    got = uniq.mapInArrow(count, schema).groupBy("field", "block").applyInPandas(total, schema).collect()  # 64 rows a field
    classes, least, all_ = {}, {}, {}
    for f in {r["field"] for r in got}:
        mine = sorted((r for r in got if r["field"] == f), key=lambda r: r["block"])
        n = np.concatenate([np.frombuffer(zlib.decompress(r["cells"]), np.int64) for r in mine])
        mean = max(n.sum() / SLOTS, 1e-9)
        cls = np.full(SLOTS, 2, np.uint8)
        cls[n > max(FREQUENT * mean, 64)] = 3
        cls[n > max(HOT * mean, 512)] = 4
        cls[n <= max(RARE * mean, 2)] = 1
        classes[f], least[f], all_[f] = cls, min(r["least"] for r in mine), int(n.sum())
    return classes, least, all_


def _squeeze(cols: np.ndarray) -> bytes:
    """Columns of integers, the first one ascending: its differences, and equal bytes of the numbers side by side."""
    wide = np.ascontiguousarray(np.concatenate([np.diff(cols[:1], prepend=0), cols[1:]]), "<i8")
    return zlib.compress(wide.view(np.uint8).reshape(*wide.shape, 8).transpose(0, 2, 1).tobytes(), 1)


def _expand(raw: bytes, cols: int = 4) -> np.ndarray:
    wide = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(cols, 8, -1).transpose(0, 2, 1)
    out = np.ascontiguousarray(wide).view("<i8")[:, :, 0].copy()
    np.cumsum(out[0], out=out[0])
    return out


def _pack(low: np.ndarray, who: np.ndarray, high_bits: int) -> bytes:
    """A sorted posting list: its length, low parts of the signatures, row numbers and, a bit each, the high parts' steps."""
    bits = np.zeros((1 << high_bits) + len(low), np.uint8)
    bits[(low >> np.uint32(16)) + np.arange(len(low))] = 1
    return len(low).to_bytes(4, "little") + low.astype("<u2").tobytes() + who.astype("<u2").tobytes() + np.packbits(bits).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int.from_bytes(blob[:4], "little")
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + 4 * m))) - np.arange(m)
    return (high.astype(np.uint32) << np.uint32(16)) | np.frombuffer(blob, "<u2", m, 4), np.frombuffer(blob, "<u2", m, 4 + 2 * m)


def _index(uniq: DataFrame, k: int, threshold: float) -> tuple[DataFrame, int, dict[int, int]]:
    """Posting lists ``bucket, blob, runs, sizes``, the number of buckets and the tokens of each field's shortest record.

    ``runs`` are the uids of a block's rows and ``sizes`` their fields and
    numbers of tokens, both as runs: every bucket gets them, so they must stay
    small against the postings whatever the number of records and of buckets.
    Where they would not, ``sizes`` holds those of the postings only.
    """
    classes, least, _ = token_table(uniq, k)
    shared = uniq.sparkSession.sparkContext.broadcast((classes, least))

    def combined(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        classes, least = shared.value
        field = b.column(0).to_numpy(zero_copy_only=False)
        h, offs = tokens(*packed_buffer(b.column(2)), k, field)
        n = np.diff(offs)
        cls = np.zeros(len(h), np.uint8)
        owner = np.repeat(field, n)
        short = np.zeros(len(n), np.int64)
        for f in np.unique(field):
            cls[owner == f] = classes[f][h[owner == f] >> np.uint32(14)]
            short[field == f] = least[f]
        budget = np.maximum(least_overlap(n, short, threshold) - 1 - SPARE, 0)
        sig, who = combinations(h, offs, cls, budget + 1)
        sig ^= np.uint64(0x5851F42D4C957F2D) * field[who].astype(np.uint64)
        return sig, who, field.astype(np.int64) << 32 | n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(combined(b)[0]) for b in _portions(batches, 2))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    # the size of the index decides the number of buckets and nothing else, so one record in SIZED_BY tells it well enough
    some = uniq.where(F.pmod(F.xxhash64("uid"), F.lit(SIZED_BY)) == 0).mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-some * SIZED_BY // PER_BUCKET))
    # signatures keep 26 to 32 bits: few others collide in a bucket, and the high parts cost a bit or two each
    high_bits = max(10, min(16, int(np.ceil(np.log2(PER_BLOCK / buckets)))))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # signatures, rows, sizes, uids
        rows = total = 0

        def block() -> pa.RecordBatch:
            sig, who, size, uid = (np.concatenate(v) for v in zip(*held))
            held.clear()
            low = ((sig >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)
            low |= (sig & np.uint64(0xFFFFFFFF)) >> np.uint64(16 - high_bits)
            del sig
            order = np.argsort(low)
            low, who = low[order], who[order]
            del order
            edges = np.searchsorted(low, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            low = low.astype(np.uint32)
            full = np.flatnonzero(np.diff(edges))
            m, runs, sizes = len(full), _steps(uid - np.arange(len(uid))), b"\0" + _steps(size)
            blobs = [_pack(low[x:y], who[x:y], high_bits) for x, y in zip(edges[full], edges[full + 1])]
            if m * len(sizes) <= 2 * len(low):
                each = [sizes] * m
            else:
                each = [b"\1" + zlib.compress(size[who[x:y]].tobytes(), 1) for x, y in zip(edges[full], edges[full + 1])]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.array([runs] * m, pa.binary()), pa.array(each, pa.binary())], names=["bucket", "blob", "runs", "sizes"])

        for whole in _portions(batches, 2):
            for at in range(0, whole.num_rows, ROWS // 4):
                b = whole.slice(at, ROWS // 4)
                sig, who, size = combined(b)
                if held and (rows + b.num_rows > ROWS or total + len(sig) > PER_BLOCK):
                    yield block()
                    rows = total = 0
                held.append((sig, (who + rows).astype(np.uint16), size, b.column(1).to_numpy(zero_copy_only=False)))
                rows, total = rows + b.num_rows, total + len(sig)
        if held:
            yield block()

    return uniq.mapInArrow(index, "bucket int, blob binary, runs binary, sizes binary"), buckets, least


def _candidates(uniq: DataFrame, k: int, threshold: float) -> DataFrame:
    """Distinct ``a, b`` record pairs (a < b) that share as many combinations as similar ones must.

    With ``c`` common tokens two records share at least ``c`` less the cost of
    the finer one's cells; the pair's own least overlap less that cost is
    therefore a lower bound that discards partly overlapping pairs unseen.
    """
    blobs, buckets, least = _index(uniq, k, threshold)
    share = threshold / (1 + threshold)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("blob", "runs", "sizes")))]
        sig, row = zip(*(_unpack(blob) for blob, _, _ in lists))
        edges = np.cumsum([0, *map(len, sig)])
        sig = np.concatenate(sig)
        order = np.argsort(sig)
        sig = sig[order]
        same = sig[1:] == sig[:-1]
        inside = np.zeros(len(sig), bool)
        inside[1:] |= same
        inside[:-1] |= same
        keep, sig = order[inside], sig[inside]
        del order, same
        if not len(keep):
            return
        hit = np.zeros(len(inside), bool)
        hit[keep] = True
        uid, size = [], []
        for (_, runs, sizes), r, x, y in zip(lists, row, edges, edges[1:]):  # only of postings that meet others
            mine = np.flatnonzero(hit[x:y])
            if len(mine):
                r = r[mine]
                uid.append(_at(runs, r) + r)
                size.append(_at(sizes[1:], r) if sizes[0] == 0 else np.frombuffer(zlib.decompress(sizes[1:]), np.int64)[mine])
        del lists, row
        names, who = np.unique(np.concatenate(uid), return_inverse=True)
        held_by = np.empty(len(names), np.int64)
        held_by[who] = np.concatenate(size)
        who = who[(np.cumsum(hit) - 1)[keep]]
        del uid, size, hit, keep, inside
        n, field = held_by & 0xFFFFFFFF, held_by >> 32
        short = np.array([least[f] for f in field.tolist()])
        budget = np.maximum(least_overlap(n, short, threshold) - 1 - SPARE, 0)

        def counted() -> pa.RecordBatch:
            code, times = np.unique(np.concatenate(held), return_counts=True)
            x, y = code // len(names), code % len(names)
            ok = (field[x] == field[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9)
            x, y, times = x[ok], y[ok], times[ok]
            need = np.maximum(np.ceil(share * (n[x] + n[y]) - 1e-9) - np.maximum(budget[x], budget[y]), 1)
            part = (_scramble(names[x].astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cols = np.stack([names[x], names[y] - names[x], times, need.astype(np.int64)])[:, order]
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(edges))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_squeeze(cols[:, i:j]) for i, j in zip(edges[full], edges[full + 1])], pa.binary())], names=["part", "rows"])

        live, d, held, met = np.arange(len(sig)), 1, [], 0
        while len(live):  # partners at distance d within a posting list
            live = live[live + d < len(sig)]
            live = live[sig[live + d] == sig[live]]
            for c in range(0, len(live), MEETINGS):
                some = live[c : c + MEETINGS]
                x, y = who[some], who[some + d]
                held.append((np.minimum(x, y) * np.int64(len(names)) + np.maximum(x, y))[x != y])
                met += len(some)
                if met >= MEETINGS:
                    yield counted()
                    held, met = [], 0
            d += 1
        if held:
            yield counted()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, gap, s, need = np.concatenate([_expand(r) for t in batches for r in t.column("rows").to_pylist()], axis=1)
        order = np.lexsort((gap, a))
        a, gap = a[order], gap[order]
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(gap, prepend=-1) != 0))
        ok = np.add.reduceat(s[order], first) >= need[order][first]
        a, gap = a[first][ok], gap[first][ok]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(a + gap)], names=["a", "b"])

    # a pair meets in as many buckets as it shares combinations, so pairs travel as packed columns and not as rows
    parts = max(buckets // 2, 8)
    found = blobs.repartition(max(buckets // 4, 8), "bucket").groupBy("bucket").applyInArrow(pairs, "part int, rows binary")
    return found.repartition(max(parts // 4, 8), "part").groupBy("part").applyInArrow(summed, "a bigint, b bigint")


def _pieces(buf: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray | None:
    """Sorted distinct ``row << 44 | piece`` of every record, exactly; None where letters or ``k`` need more bits."""
    code = _CODE[buf]
    if 4 * k > 44 or len(offs) > 1 << 20 or (code == 0).any():
        return None
    n = np.maximum(np.diff(offs) - k + 1, 0)
    key = np.zeros(max(len(buf) - k + 1, 0), np.uint64)
    for j in range(k):
        key = (key << np.uint64(4)) | code[j : len(key) + j].astype(np.uint64)
    at = np.repeat(offs[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(44)) | key[at])
    return out[np.concatenate([[True], out[1:] != out[:-1]])[: len(out)]]  # far faster than a hashed unique


def similarities(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """Shared pieces over pieces in either, of every pair of packed sequences."""
    left, right = packed_buffer(a), packed_buffer(b)
    p, q = _pieces(*left, k), _pieces(*right, k)
    rows = len(a)
    if p is not None and q is not None:
        n, m = (np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=rows) for v in (p, q))
        both = np.sort(np.concatenate([p, q]))
        both = both[1:][both[1:] == both[:-1]]
        c = np.bincount((both >> np.uint64(44)).astype(np.int64), minlength=rows)
        return c / np.maximum(n + m - c, 1)
    sim = np.zeros(rows)
    for i in range(rows):  # other letters: pair by pair
        x, y = (v[0][v[1][i] : v[1][i + 1]].tobytes().decode() for v in (left, right))
        x, y = {x[j : j + k] for j in range(len(x) - k + 1)}, {y[j : j + k] for j in range(len(y) - k + 1)}
        sim[i] = len(x & y) / max(len(x | y), 1)
    return sim


def _verify(pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``a, b, similarity`` of candidate pairs carrying their packed sequences ``ka`` and ``kb``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, 2, 3):
            sim = similarities(b.column(2), b.column(3), k)
            ok = np.flatnonzero(sim >= threshold)
            take = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(sim[ok])], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "ka", "kb").mapInArrow(run, "a bigint, b bigint, similarity double")


# Letters a half-byte can stand for, and their hexadecimal digits.
LETTERS, DIGITS = "ACGTNRYKMSWBDHV", "123456789ABCDEF"


def pack(seq: Column) -> Column:
    """A sequence in half-bytes, or after a zero byte as it is if it has other letters; reversible."""
    half = F.unhex(F.translate(seq, LETTERS, DIGITS))
    whole = F.concat(F.unhex(F.lit("00")), F.encode(seq, "UTF-8"))
    return F.when(seq.rlike(f"^[{LETTERS}]+$"), half).otherwise(whole)


def unpack(key: Column) -> Column:
    plain = F.hex(key)
    half = F.translate(F.regexp_replace(plain, "^0", ""), DIGITS, LETTERS)
    return F.when(plain.startswith("00"), F.decode(F.unhex(F.substring(plain, F.lit(3), F.length(plain))), "UTF-8")).otherwise(half)


_LETTER = np.zeros(16, np.uint8)
_LETTER[1:] = np.frombuffer(LETTERS.encode(), np.uint8)


_CODE = np.zeros(256, np.uint8)
_CODE[_LETTER[1:]] = np.arange(1, 16)


def packed_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and row offsets of packed sequences, as :func:`text_buffer` of the sequences themselves."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64, count=len(col) + col.offset + 1)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    full = np.flatnonzero(np.diff(offs) > 0)
    plain = full[raw[offs[full]] == 0]  # kept as it was
    if len(plain):
        kind = np.zeros(len(col), bool)
        kind[plain] = True
        words = [raw[a + 1 : z] if p else _spell(raw[a:z]) for p, a, z in zip(kind, offs, offs[1:])]
        return (np.concatenate(words) if words else raw), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    half = np.empty((len(raw), 2), np.uint8)
    half[:, 0], half[:, 1] = raw >> 4, raw & 15
    half = half.reshape(-1)
    keep = half > 0  # only the first half-byte of an odd sequence is 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return _LETTER[half[keep]], before[2 * offs]


def _spell(raw: np.ndarray) -> np.ndarray:
    half = np.stack([raw >> 4, raw & 15], axis=1).reshape(-1)
    return _LETTER[half[half > 0]]


def unique_sequences(df: DataFrame) -> DataFrame:
    """``field, uid, key, low, high``: one row per distinct sequence (packed), with its least and greatest id.

    Rows of one length lie together, so that sizes of the index are few runs.
    """
    g = df.groupBy("field", pack(F.col("seq")).alias("key")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    g = g.sortWithinPartitions("field", F.length("key"), F.expr("substring(key, 1, 1) >= X'10'"))  # an odd number of letters starts with a zero
    return stage(g.select("field", F.monotonically_increasing_id().alias("uid"), "key", "low", "high"), "near-unique")


def spelled(uniq: DataFrame) -> DataFrame:
    """``field, uid, seq`` of packed sequences."""
    return uniq.select("field", "uid", unpack(F.col("key")).alias("seq"))


def fits(df: DataFrame, width: str) -> bool:
    """Whether a table of ``width`` bytes a row (an expression) is small enough to send to all tasks."""
    return (df.agg(F.sum(F.expr(width))).first()[0] or 0) <= BROADCAST_BYTES


def similar_sequences(df: DataFrame, k: int = 11, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similar pairs of distinct sequences, and the ids behind each sequence.

    ``df`` has ``field int, id bigint, seq string``; only sequences of one field
    are compared.  Returns ``a, b, similarity`` over distinct sequences (uids);
    ``field, uid, id`` of every id; and the same rows for sequences that several
    ids share.  Null ids and sequences are left out.  Sequences shorter than
    ``k`` have no tokens and are similar to none, not even to their copies.
    Repeated rows collapse; an empty table gives empty results.
    """
    df = df.where(F.col("id").isNotNull() & (F.length("seq") >= k))
    uniq = unique_sequences(df)
    cand = stage(_candidates(uniq.select("field", "uid", "key"), k, threshold), "near-candidates")
    need = cand.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    few = fits(cand, "32")
    texts = stage(uniq.select("uid", "key").join(F.broadcast(need) if few else need, "uid", "left_semi"), "near-texts")
    both = cand.join(texts.select(F.col("uid").alias("a"), F.col("key").alias("ka")), "a").join(texts.select(F.col("uid").alias("b"), F.col("key").alias("kb")), "b")
    pairs = stage(_verify(both, k, threshold), "near-pairs")
    many = stage(spelled(uniq.where("low < high")), "near-many")
    mine = df.select("field", "id", "seq")
    copies = stage(mine.join(F.broadcast(many) if fits(many, "length(seq) + 16") else many, ["field", "seq"]).select("field", "uid", "id").distinct(), "near-copies")
    one = uniq.where("low = high").select("field", "uid", F.col("low").alias("id"))
    return pairs, one.unionByName(copies), copies


def similar_ids(df: DataFrame, k: int = 11, threshold: float = 0.5) -> DataFrame:
    """``field, id_low, id_high`` of all pairs of different ids with similar sequences."""
    pairs, members, copies = similar_sequences(df, k, threshold)
    p = F.broadcast(pairs) if fits(pairs, "24") else pairs
    held = members.join(p.select(F.col("a").alias("uid"), "b"), "uid").select("field", F.col("id").alias("x"), "b")
    held = stage(held, "near-held")
    both = members.select(F.col("uid").alias("b"), F.col("id").alias("y")).join(F.broadcast(held) if fits(held, "40") else held, "b").select("field", "x", "y")
    same = copies.select("field", "uid", F.col("id").alias("x")).join(copies.select("uid", F.col("id").alias("y")), "uid").where("x < y").select("field", "x", "y")
    out = both.unionByName(same).where("x <> y")
    return out.select("field", F.least("x", "y").alias("id_low"), F.greatest("x", "y").alias("id_high")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` (the least node of its component) for all nodes of ``a, b`` edges.

    Every round hooks each root to the least root next to it and halves the
    pointer paths, until none moves; rounds grow with the logarithm of the longest path.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.distinct(), "near-edges")
    label = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "near-labels")
    last = label
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        step = label.join(near, label["node"] == near["a"]).select("node", F.least("root", "m").alias("new"), "root")
        hook = step.groupBy("root").agg(F.min("new").alias("to"))
        moved = step.join(hook, "root").select("node", F.least("new", "to").alias("new"), F.col("root").alias("old"))
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nxt = stage(moved.join(jump, "new", "left").select("node", F.coalesce("far", "new").alias("root"), "old"), "near-labels")
        discard(last)
        last, label = nxt, nxt.select("node", "root")
        if nxt.where("root <> old").isEmpty():
            break
    return label


def classes(df: DataFrame, k: int = 11, threshold: float = 0.5) -> DataFrame:
    """``field, id, class_id, n_links``: one row per id; the class is named by its least id.

    ``n_links`` counts the different sequences similar to the id's own.  An id
    with several sequences joins their classes.
    """
    pairs, members, _ = similar_sequences(df, k, threshold)
    links = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).groupBy("uid").agg(F.count("*").alias("n"))
    # ids and sequences are both nodes: sequences keep their uid, ids hang on their sequences
    multi = members.groupBy("field", "id").agg(F.min("uid").alias("u"), F.max("uid").alias("v"), F.count("*").alias("c")).where("c > 1").select("field", "id")
    tied = members.join(multi, ["field", "id"]).groupBy("field", "id").agg(F.min("uid").alias("a"), F.collect_set("uid").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")
    root = components(pairs.select("a", "b").unionByName(tied))
    m = stage(members.join(root.withColumnRenamed("node", "uid"), "uid", "left").join(links, "uid", "left").select("field", "id", F.coalesce("root", "uid").alias("root"), F.coalesce("n", F.lit(0)).alias("n")), "near-members")
    name = m.groupBy("root").agg(F.min("id").alias("class_id"))
    return m.groupBy("field", "id", "root").agg(F.sum("n").alias("n_links")).join(name, "root").groupBy("field", "id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
