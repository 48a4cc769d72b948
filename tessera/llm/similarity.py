"""Clusters of mutually similar categorical records by density peaks.

Density: the sites are cut into a few windows; in each window the records that
agree with a record in the whole window are counted exactly, and the counts
are summed.  Every record points to its nearest denser neighbour (a record of
greater density within the radius), found by blocked neighbour joins; followers
are neighbours like any others.  A record without one is a peak, and following
the pointers gives the labels.

Neighbour joins: the sites are cut into so many blocks that two records within
a gap agree in a whole block (pigeonhole over the differing sites).  A block
with few unknown sites is indexed under all its completions, so unknown sites
cost no block.

1. All records meet in ``near + 1`` blocks, ``near`` being below half the
   radius; every pair up to ``near`` meets, so a pointer of at most that gap is
   the nearest.
2. The records without one (peaks, and those whose nearest is farther) meet
   every record that can be denser in ``radius + 1`` blocks.

Where unknown sites break the blocks, the first join runs over the whole radius
and the records concerned are compared with all others.  Buckets are searched
in full, hot ones by exact division (:class:`_Search`).

So a record is a peak exactly if no denser record lies within the radius, and
every other record points to its nearest denser one, of several the densest, of
these the first by a hash of key and codes.  Neither the files nor the batches
nor :data:`CHUNK` change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.storage import discard, stage

CHUNK = 8192  # an eighth of the rows handled together, unless one bucket has more; no result depends on it
COHORT = 16  # densest records of a group that all its records meet before it is divided; 16 times as many are not divided
WINDOWS = 5  # windows of sites whose agreement makes the density
COMPLETIONS = 64  # most completions of a block with unknown sites
SLOTS = 1 << 18  # least densities of the second join: a fixed size, whatever the table
BROADCAST_BYTES = 16 << 20  # most bytes of asking records sent to all tasks; beyond it they are shuffled
APART = 20_000  # records compared with all others at a time, where unknown sites break the blocks
_R = np.random.default_rng(20_240_601).integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
POINT = "uid bigint, density bigint, tie bigint, codes binary"


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sites:
    """How records of a table are packed: ``sites`` codes from ``low`` on, in bit planes, the known sites last."""

    def __init__(self, sites: int, low: int, high: int, radius: int, unknown: int):
        self.sites, self.low, self.radius = sites, low, radius
        self.values = high - low + 1
        self.planes = max(1, int(high - low).bit_length()) + 1
        self.bytes = -(-sites // 8)
        self.words = -(-self.bytes // 8)
        self.m = max(1, min(radius + 1, sites))
        self.unknown = unknown
        self.spared = self.completes(self.m)
        self.full = sites - 2 * unknown > radius  # any two records share more sites than the radius

    def completes(self, parts: int) -> bool:
        """Whether every block of every record can be completed and has a known site."""
        return self.values ** min(self.unknown, 64) <= COMPLETIONS and (not self.unknown or self.unknown < self.sites // parts)

    def pack(self, col: pa.Array) -> pa.Array:
        """Lists of codes as fixed-size bytes; absent sites are unknown."""
        lens = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = col.flatten()
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        vals = np.where(known, flat.fill_null(self.low).to_numpy(zero_copy_only=False).astype(np.int64) - self.low, 0)
        even = (lens == self.sites).all()
        if not even:
            row = np.repeat(np.arange(len(col)), lens)
            at = (row, np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens))
        out = np.zeros((len(col), self.planes, self.bytes), np.uint8)
        for p in range(self.planes):
            on = known if p == self.planes - 1 else (vals >> p) & 1 == 1
            if even:
                bits = on.reshape(len(col), self.sites)
            else:
                bits = np.zeros((len(col), self.sites), bool)
                bits[at] = on
            out[:, p] = np.packbits(bits, axis=1)
        offs = np.arange(len(col) + 1, dtype=np.int32) * (self.planes * self.bytes)
        return pa.Array.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(offs), pa.py_buffer(out.tobytes())])

    def read(self, col: pa.Array) -> np.ndarray:
        """Packed bytes as ``rows, planes, bytes``."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        width = self.planes * self.bytes
        data, offs = col.buffers()[2], np.frombuffer(col.buffers()[1], np.int32)[col.offset :]
        if not len(col):
            return np.zeros((0, self.planes, self.bytes), np.uint8)
        return np.frombuffer(data, np.uint8)[offs[0] : offs[0] + len(col) * width].reshape(len(col), self.planes, self.bytes)

    def wide(self, raw: np.ndarray) -> np.ndarray:
        """``planes, words, rows`` of 64 bits for the comparison."""
        padded = np.zeros((len(raw), self.planes, self.words * 8), np.uint8)
        padded[:, :, : self.bytes] = raw
        return np.ascontiguousarray(padded.view(np.uint64).transpose(1, 2, 0))

    def differ(self, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing sites of the pairs ``i, j``; beyond the radius where they share too few known sites."""
        n, common = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for b in range(self.words):
            both = w[-1, b][i] & w[-1, b][j]
            x = w[0, b][i] ^ w[0, b][j]
            for p in range(1, self.planes - 1):
                x |= w[p, b][i] ^ w[p, b][j]
            n += np.bitwise_count(x & both)
            if not self.full:
                common += np.bitwise_count(both)
        return n if self.full else np.where(common > self.radius, n, self.radius + 1)

    def codes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (0 where unknown) and known marks, ``rows, sites``."""
        bits = np.unpackbits(raw, axis=2, count=self.sites)
        x = bits[:, 0].astype(np.int64)
        for p in range(1, self.planes - 1):
            x |= bits[:, p].astype(np.int64) << p
        return x, bits[:, -1].astype(bool)

    def blocks(self, raw: np.ndarray, parts: int, picked: list[int] | None = None, complete: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and bucket keys of the blocks (all or the ``picked`` ones) of ``parts``."""
        x, known = self.codes(raw)
        weight = np.resize(_R, self.sites)
        terms = (x.astype(np.uint64) + np.uint64(1)) * weight * known
        edges = np.linspace(0, self.sites, parts + 1).astype(int)
        rows, keys = [], []
        for b in range(parts) if picked is None else picked:
            lo, hi = edges[b], edges[b + 1]
            base = terms[:, lo:hi].sum(1, dtype=np.uint64) + _mix(np.full(1, parts * 100_003 + b + 1, np.uint64))
            open_ = (hi - lo) - known[:, lo:hi].sum(1)
            whole = np.flatnonzero(open_ == 0)
            rows.append(whole), keys.append(base[whole])
            for t in np.unique(open_[(open_ > 0)]) if complete else []:
                if t >= hi - lo or self.values ** int(t) > COMPLETIONS:
                    continue
                some = np.flatnonzero(open_ == t)
                gaps = np.nonzero(~known[some, lo:hi])[1].reshape(len(some), t) + lo
                for guess in product(range(self.values), repeat=int(t)):
                    rows.append(some)
                    keys.append(base[some] + ((np.array(guess, np.uint64) + np.uint64(1)) * weight[gaps]).sum(1, dtype=np.uint64))
        return np.concatenate(rows), _mix(np.concatenate(keys)).astype(np.int64)

    def lost(self, raw: np.ndarray, parts: int) -> np.ndarray:
        """Blocks of each record with too many unknown sites to complete."""
        _, known = self.codes(raw)
        edges = np.linspace(0, self.sites, parts + 1).astype(int)
        n = np.zeros(len(raw), np.int64)
        for lo, hi in zip(edges, edges[1:]):
            open_ = (hi - lo) - known[:, lo:hi].sum(1)
            n += (open_ > 0) & ((open_ >= hi - lo) | (float(self.values) ** np.minimum(open_, 64) > COMPLETIONS))
        return n

    def apart(self, raw: np.ndarray) -> np.ndarray:
        """Records whose lost blocks break the guarantee of the blocks, and that can have neighbours at all."""
        if self.spared:
            return np.zeros(len(raw), bool)
        many = np.unpackbits(raw[:, -1], axis=1, count=self.sites).sum(1) > self.radius
        return many & (self.lost(raw, self.m) > (self.m - self.radius - 1) // 2)


def _sites(src: DataFrame, radius: int) -> Sites | None:
    known = F.size(F.filter("_x", lambda v: v.isNotNull()))
    row = src.agg(F.max(F.size("_x")), F.max(F.size("_x") - known), F.min(F.size("_x")), F.min(F.array_min("_x")), F.max(F.array_max("_x"))).first()
    if row[0] is None:
        return None
    return Sites(row[0], row[3], row[4], radius, row[1] + row[0] - row[2])


def _settle(points: DataFrame, s: Sites) -> None:
    """Chooses the number of blocks where some blocks can't be completed: the fewest that leave few records apart."""
    if s.spared or s.sites <= s.radius + 1:
        return
    tries = [m for m in (s.radius + 1 + 2 * k for k in (0, 1, 2, 4, 8, 16, 32)) if m <= s.sites]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(tries) + 1, np.int64)
        for b in batches:
            raw = s.read(b.column(0))
            many = np.unpackbits(raw[:, -1], axis=1, count=s.sites).sum(1) > s.radius
            held[-1] += len(raw)
            for i, m in enumerate(tries):
                held[i] += (many & (s.lost(raw, m) > (m - s.radius - 1) // 2)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(held)], names=["i", "n"])

    got = {r["i"]: r["n"] for r in points.select("codes").mapInArrow(count, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row a try
    total = got.get(len(tries), 0)
    few = [m for i, m in enumerate(tries) if got.get(i, 0) * 1000 <= total]
    s.m = few[0] if few else min(tries, key=lambda m: got.get(tries.index(m), 0))


def _densities(points: DataFrame, s: Sites) -> DataFrame:
    """Adds ``density``: other records that agree in a wholly known window, summed over the windows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, key = s.blocks(s.read(b.column(0)), min(WINDOWS, s.sites), complete=False)
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, key = s.blocks(s.read(b.column(1)), min(WINDOWS, s.sites), complete=False)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(key)], names=["uid", "key"])

    counts = points.select("codes").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    mine = points.select("uid", "codes").mapInArrow(keys, "uid bigint, key bigint").join(counts, "key")
    found = mine.groupBy("uid").agg(F.sum(F.col("n") - 1).alias("density"))
    return points.join(found, "uid", "left").select("id", "uid", F.coalesce("density", F.lit(0).cast("bigint")).alias("density"), "tie", "codes")


def _press(cols: list[np.ndarray]) -> bytes:
    """Columns of equally many rows as bytes, place by place of their values, compressed; :func:`_open` reads them."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols), "zstd", asbytes=True)


def _open(raw: bytes, rows: int, types: list[tuple[type, int]]) -> list[np.ndarray]:
    """The columns of :func:`_press`, each of ``type`` and bytes a row."""
    data = np.frombuffer(pa.decompress(raw, rows * sum(n for _, n in types), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, n in types:
        out.append(np.ascontiguousarray(data[at : at + rows * n].reshape(n, rows).T).view(kind))
        at += rows * n
    return out


def _spread(points: DataFrame, s: Sites, parts: int, n: int, least: object = None) -> DataFrame:
    """Records of every bucket as packed columns, by the ``n`` groups of the buckets; ``least`` (a broadcast table) keeps
    records that can be denser than an asking one.  A bucket goes by half of its key: two that share it only meet in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = s.read(b.column(3))
            row, key = s.blocks(raw, parts)
            if least is not None:
                ok = b.column(1).to_numpy()[row] >= least.value[key & (SLOTS - 1)]
                row, key = row[ok], key[ok]
            g = ((key.view(np.uint64) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            o = np.lexsort((key, g))
            g, row, key = g[o], row[o], key.view(np.uint64)[o].astype(np.uint32)
            uid, density, tie = (b.column(i).to_numpy() for i in range(3))
            asks = b.column(4).to_numpy(zero_copy_only=False).astype(np.uint8)
            raw = raw.reshape(len(raw), -1)
            start, size = _groups(g)
            packed = []
            for a, k in zip(start, size):
                at = row[a : a + k]
                packed.append(_press([key[a : a + k], uid[at], density[at], tie[at], asks[at], raw[at]]))
            yield pa.RecordBatch.from_arrays([pa.array(g[start]), pa.array(size), pa.array(packed, pa.binary())], names=["g", "size", "packed"])

    return points.select("uid", "density", "tie", "codes", "asks").mapInArrow(run, "g bigint, size bigint, packed binary")


FOUND = "uid bigint, gap int, rank bigint, tie bigint, parent bigint"


def _found(uid: np.ndarray, gap: np.ndarray, density: np.ndarray, tie: np.ndarray, parent: np.ndarray) -> pa.Table:
    cols = [pa.array(uid), pa.array(gap.astype(np.int32)), pa.array(-density), pa.array(tie), pa.array(parent)]
    return pa.Table.from_arrays(cols, names=["uid", "gap", "rank", "tie", "parent"])


def _best(s: Sites, w: np.ndarray, ask: np.ndarray, lead: np.ndarray, order: tuple[np.ndarray, ...], at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest denser partner among the pairs ``ask[at], lead[to]``: row, partner, gap. ``order`` is uid, tie, density."""
    uid, tie, density = order
    out = []
    for a in range(0, len(at), 1 << 20):
        i, j = ask[at[a : a + (1 << 20)]], lead[to[a : a + (1 << 20)]]
        up = (density[j] > density[i]) | ((density[j] == density[i]) & ((tie[j] < tie[i]) | ((tie[j] == tie[i]) & (uid[j] < uid[i]))))
        i, j = i[up], j[up]
        gap = s.differ(w, i, j)
        near = gap <= s.radius
        i, j, gap = i[near], j[near], gap[near]
        o = np.lexsort((uid[j], tie[j], -density[j], gap, i))
        first = np.flatnonzero(np.diff(i[o], prepend=-1)) if len(o) else o
        out.append((i[o][first], j[o][first], gap[o][first]))
    i, j, gap = (np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return i, j, gap


def _groups(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the groups of a sorted column."""
    start = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(group)))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + n - 1`` of every range in turn."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Search:
    """Nearest denser record of the asking rows within their buckets: exact for gaps up to ``near``.

    The rows come densest first, so a row's partners are those before it in its group.  A group too large for all pairs
    meets its densest rows first; ``x`` differs from the densest, ``h``, in the sites D.  A row that agrees with ``x`` in
    no site of D is at least as far from ``x`` as ``h`` and no denser, so only rows that have the code of ``x`` (or none)
    at a site of D can be nearer: the group is divided into one list a site and code, and the lists are groups in turn.
    A row within ``g`` of ``x`` misses at most ``g`` sites of D, so any ``g + 1`` of them will do: those of the shortest
    lists.  Groups of records that have little in common are divided by their cheapest blocks instead.
    """

    def __init__(self, s: Sites, near: int, bucket: np.ndarray, asks: np.ndarray, raw: np.ndarray):
        self.s, self.near, self.raw, self.n = s, near, raw, len(bucket)
        self.w = s.wide(raw)
        self.best = np.full(self.n, (s.radius + 1) * self.n)  # gap * n + row of the best partner
        group, row, ask, cut = np.unique(bucket, return_inverse=True)[1], np.arange(self.n), asks, np.zeros(self.n, bool)
        while len(row):
            group, row, ask, cut = self.round(group, row, ask, cut)

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        d = self.s.differ(self.w, i, j)
        ok = (d <= self.s.radius) & (i != j)
        np.minimum.at(self.best, i[ok], d[ok] * self.n + j[ok])

    def whole(self, row: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
        """The rows at ``at`` meet all before them in their groups, in bounded batches."""
        step, a = np.cumsum(rank[at]), 0
        while a < len(at):
            z = max(a + 1, int(np.searchsorted(step, (step[a - 1] if a else 0) + (1 << 19), side="right")))
            k = rank[at[a:z]]
            self.meet(np.repeat(row[at[a:z]], k), row[_ranges(at[a:z] - k, k)])
            a = z

    def round(self, group: np.ndarray, row: np.ndarray, ask: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, ...]:
        s, n = self.s, self.n
        o = np.lexsort((row, group))
        group, row, ask, cut = group[o], row[o], ask[o] & (self.best[row[o]] >= n), cut[o]  # nothing beats a gap of 0
        start, size = _groups(group)
        at = np.arange(len(row))
        last = np.maximum.reduceat(np.where(ask, at, -1), start)
        keep = at <= np.repeat(last, size)  # rows behind the last asking one lead nobody
        group, row, ask, cut = group[keep], row[keep], ask[keep], cut[keep]
        start, size = _groups(group)
        rank = np.arange(len(row)) - np.repeat(start, size)
        big = np.repeat(size > 16 * COHORT, size)
        self.whole(row, np.flatnonzero(ask & ~big), rank)
        if not big.any():
            return (row[:0],) * 4
        group, row, ask, cut, rank = group[big], row[big], ask[big], cut[big], rank[big]
        start, size = _groups(group)
        group = np.repeat(np.arange(len(start)), size)
        first = start[group]
        for r in range(COHORT):
            live = np.flatnonzero(ask & (rank > r) & (self.best[row] >= n))
            self.meet(row[live], row[first[live] + r])
        ask &= (rank >= COHORT) & (self.best[row] >= n)
        cost = np.bincount(group, rank * ask, len(start))  # pairs, if all of a group meet
        out = []
        gap = np.concatenate([s.differ(self.w, row[a : a + (1 << 19)], row[first[a : a + (1 << 19)]]) for a in range(0, len(row), 1 << 19)])
        done = np.bincount(group, gap, len(start)) > 2 * s.radius * size if s.full else np.zeros(len(start), bool)
        if not done.all():
            got, mine, lone = self.lists(group, row, ask, start, cost, ~done)
            self.whole(row, lone, rank)
            out.append((*got, cut[got[-1]]))
            done = ~mine
        if done.any():
            got, mine = self.parts(group, row, ask, cost, done & ~cut[start])
            base = out[0][0].max(initial=-1) + 1 if out else 0
            out.append((got[0] + base, got[1], np.ones(len(got[0]), bool)))
            self.whole(row, np.flatnonzero(ask & (done & ~mine)[group]), rank)
        group, at, cut = (np.concatenate(v) for v in zip(*[(g[0], g[-2], g[-1]) for g in out]))
        asks = np.concatenate([out[0][1] if len(g) == 4 else ask[g[1]] for g in out])
        return group, row[at], asks, cut

    def lists(self, group: np.ndarray, row: np.ndarray, ask: np.ndarray, start: np.ndarray, cost: np.ndarray, able: np.ndarray) -> tuple:
        """Lists by site and code where they are cheaper: list, asking mark and place of their rows; the groups divided; asking rows that can't be."""
        s = self.s
        hx, hk = s.codes(self.raw[row[start]])
        at, key, open_at, open_key = [], [], [], []
        k = np.zeros(len(row), np.int64)
        sound = np.ones(len(row), bool)
        able_at = np.flatnonzero(able[group])
        for a in range(0, len(able_at), 1 << 14):
            e = able_at[a : a + (1 << 14)]
            x, known = s.codes(self.raw[row[e]])
            g = group[e]
            both = known & hk[g]
            i, site = np.nonzero(both & (x != hx[g]))
            at.append(e[i]), key.append((g[i] * s.sites + site) * s.values + x[i, site])
            k[e] = np.bincount(i, minlength=len(e))
            sound[e] = both.sum(1) > s.radius
            i, site = np.nonzero(hk[g] & ~known)
            open_at.append(e[i]), open_key.append(g[i] * s.sites + site)
        at, key, open_at, open_key = (np.concatenate(v) for v in (at, key, open_at, open_key))
        lone = ask & ~sound & able[group]  # the densest is no partner of these, so it bounds nothing
        ask = ask & sound
        sizes = np.unique(key, return_inverse=True, return_counts=True)
        opens = np.unique(open_key, return_counts=True)
        n = sizes[2][sizes[1]]
        to = np.searchsorted(opens[0], key // s.values)
        hit = (to < len(opens[0])) & (np.append(opens[0], -1)[to] == key // s.values)
        n = n + np.where(hit, np.append(opens[1], 0)[to], 0)
        o = np.flatnonzero(ask[at])
        o = o[np.lexsort((n[o], at[o]))]
        first, many = _groups(at[o])
        nth = np.arange(len(o)) - np.repeat(first, many)
        picked = np.zeros(len(at), bool)
        picked[o] = nth <= np.minimum(self.best[row[at[o]]] // self.n, self.near)
        price = np.bincount(group[at], picked * (n / 2) + 10, len(able)) + np.bincount(group, lone * (np.arange(len(row)) - start[group]), len(able))
        mine = able & (price < 0.7 * cost)
        picked &= mine[group[at]]
        lists = np.unique(key[picked])
        to = np.searchsorted(lists, key)
        lead = (to < len(lists)) & (np.append(lists, -1)[to] == key)
        lo, hi = np.searchsorted(lists, open_key * s.values), np.searchsorted(lists, (open_key + 1) * s.values)
        more = np.repeat(open_at, hi - lo)
        got = np.concatenate([to[lead], _ranges(lo, hi - lo)]), np.concatenate([picked[lead], np.zeros(len(more), bool)]), np.concatenate([at[lead], more])
        return got, mine, np.flatnonzero(lone & mine[group])

    def parts(self, group: np.ndarray, row: np.ndarray, ask: np.ndarray, cost: np.ndarray, able: np.ndarray) -> tuple:
        """Buckets by the cheapest ``near + 1`` of twice as many blocks where they are cheaper: bucket and place of their rows; the groups divided."""
        s, m = self.s, 2 * (self.near + 1)
        none = (np.zeros(0, np.int64),) * 2
        if not s.completes(m) or not able.any():
            return none, np.zeros(len(able), bool)
        mine = np.flatnonzero(able[group])
        kept, price = [], np.full((m, len(able)), np.inf)
        for b in range(m):
            at, key = s.blocks(self.raw[row[mine]], m, [b])
            at = mine[at]
            o = np.lexsort((key, group[at]))
            at, key = at[o], key[o]
            new = (np.diff(key, prepend=0) != 0) | (np.diff(group[at], prepend=-1) != 0)
            bucket = np.cumsum(new) - 1
            size = np.bincount(bucket)[bucket]
            price[b] = np.bincount(group[at], size / 2 * ask[at] + 5, len(able))
            kept.append((bucket, at))
        rank = np.argsort(np.argsort(price, axis=0, kind="stable"), axis=0, kind="stable")
        use = rank <= self.near
        cheap = able & (np.where(use, price, 0).sum(0) < 0.7 * cost)
        out, base = [none], 0
        for b, (bucket, at) in enumerate(kept):
            ok = (use[b] & cheap)[group[at]]
            out.append((bucket[ok] + base, at[ok]))
            base += bucket.max(initial=-1) + 1
        return tuple(np.concatenate(v) for v in zip(*out)), cheap


def _in_buckets(points: DataFrame, s: Sites, near: int, parts: int, n_points: int, least: object = None) -> DataFrame:
    """Pointer candidates of the ``points`` that ask from all of their buckets; none up to ``near`` is missed."""
    types = [(np.uint32, 4), (np.int64, 8), (np.int64, 8), (np.int64, 8), (np.uint8, 1), (np.uint8, s.planes * s.bytes)]

    def meet(t: pa.Table) -> pa.Table:
        got = [_open(p.as_py(), n.as_py(), types) for n, p in zip(t.column("size"), t.column("packed"))]
        bucket, uid, density, tie, asks, raw = (np.concatenate(v) for v in zip(*got))
        del got
        bucket, uid, density, tie, asks = (v[:, 0] for v in (bucket, uid, density, tie, asks))
        o = np.lexsort((bucket, uid, tie, -density))
        o = o[(np.diff(uid[o], prepend=-1) != 0) | (np.diff(bucket[o].astype(np.int64), prepend=-1) != 0)]  # nothing meets itself
        uid, density, tie = uid[o], density[o], tie[o]
        best = _Search(s, near, bucket[o], asks[o] > 0, raw[o].reshape(len(o), s.planes, s.bytes)).best
        has = np.flatnonzero(best < (near + 1) * len(o))  # a farther one is left to the join over the whole radius
        to = best[has] % len(o)
        # a record may be here in several buckets
        one = np.lexsort((best[has], uid[has]))
        one = one[np.diff(uid[has][one], prepend=-1) != 0]
        has, to = has[one], to[one]
        return _found(uid[has], best[has] // len(o), density[to], tie[to], uid[to])

    n = max(1, -(-n_points * parts // (8 * CHUNK)))
    return _spread(points, s, parts, n, least).groupBy("g").applyInArrow(meet, FOUND)


def _in_place(points: DataFrame, open_: DataFrame, s: Sites) -> DataFrame:
    """As :func:`_in_full` for few ``open_`` records: they go to all tasks, and no other record moves."""
    cols = ["uid", "density", "tie", "codes"]
    held = open_.select(*cols).toArrow()
    shared = points.sparkSession.sparkContext.broadcast(tuple(held.column(c).combine_chunks() for c in cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = shared.value
        raw, k = s.read(mine[3]), len(mine[0])
        row, key = s.blocks(raw, s.m)
        o = np.argsort(key)
        row, key = row[o], key[o]
        for b in batches:
            theirs = s.read(b.column(3))
            at, want = s.blocks(theirs, s.m)
            lo, n = np.searchsorted(key, want), np.searchsorted(key, want, side="right")
            n -= lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            order = tuple(np.concatenate([mine[f].to_numpy(), b.column(f).to_numpy()]) for f in (0, 2, 1))
            uid, tie, density = order
            w = s.wide(np.concatenate([raw, theirs]))
            step, a = np.cumsum(n), 0
            while a < len(n):  # pairs in bounded batches
                z = max(a + 1, int(np.searchsorted(step, (step[a - 1] if a else 0) + (1 << 21), side="right")))
                c = n[a:z]
                ask = row[np.repeat(lo[a:z], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                i, j, gap = _best(s, w, ask, np.repeat(k + at[a:z], c), order, np.arange(len(ask)), np.arange(len(ask)))
                yield from _found(uid[i], gap, density[j], tie[j], uid[j]).to_batches()
                a = z

    return points.select(*cols).mapInArrow(run, FOUND)


def _in_full(points: DataFrame, open_: DataFrame, s: Sites) -> DataFrame:
    """Pointer candidates of the ``open_`` records from every record that can be denser, over all blocks."""
    if open_.count() * (s.planes * s.bytes + 24) <= BROADCAST_BYTES:
        return _in_place(points, open_, s)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full(SLOTS, np.iinfo(np.int64).max)
        for b in batches:
            row, key = s.blocks(s.read(b.column(0)), s.m)
            np.minimum.at(low, key & (SLOTS - 1), b.column(1).to_numpy()[row])
        at = np.flatnonzero(low < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(low[at])], names=["slot", "low"])

    got = open_.select("codes", "density").mapInArrow(least, "slot bigint, low bigint").groupBy("slot").agg(F.min("low").alias("low")).toArrow()  # at most SLOTS rows
    low = np.full(SLOTS, np.iinfo(np.int64).max)
    low[got.column("slot").to_numpy()] = got.column("low").to_numpy()
    shared = points.sparkSession.sparkContext.broadcast(low)
    marked = points.join(open_.select("uid", F.lit(True).alias("asks")), "uid", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return _in_buckets(marked, s, s.radius, s.m, points.count(), shared)


def _with_apart(points: DataFrame, s: Sites) -> list[DataFrame]:
    """Pointer candidates between the records whose unknown sites break the blocks and all records, block by block."""
    if s.spared:
        return []

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(np.flatnonzero(s.apart(s.read(b.column(3))))))

    cols = ["uid", "density", "tie", "codes"]
    few = stage(points.select(*cols).mapInArrow(pick, POINT), "peaks-apart")
    total = few.count()
    parts = -(-total * 5 // (4 * APART)) if total > APART else min(total, 1)
    out = []
    for k in range(parts):
        part = few.where(F.pmod(F.xxhash64("uid"), F.lit(parts)) == k).toArrow()  # about APART rows of fixed size
        shared = points.sparkSession.sparkContext.broadcast(tuple(part.column(c).combine_chunks() for c in cols))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = shared.value
            k = len(mine[0])
            for b in batches:
                for x in range(0, b.num_rows, 1024):
                    c = b.slice(x, 1024)
                    order = tuple(np.concatenate([mine[f].to_numpy(), c.column(f).to_numpy()]) for f in (0, 2, 1))
                    uid, tie, density = order
                    w = s.wide(np.concatenate([s.read(mine[3]), s.read(c.column(3))]))
                    few, all_ = np.arange(k), np.arange(k, len(uid))
                    f, a = np.repeat(few, len(all_)), np.tile(all_, k)
                    for i, j in ((f, a), (a, f)):
                        row, to, gap = _best(s, w, np.arange(len(uid)), np.arange(len(uid)), order, i, j)
                        yield from _found(uid[row], gap, density[to], tie[to], uid[to]).to_batches()

        out.append(points.select(*cols).mapInArrow(run, FOUND))
    return out


def _nearest(found: DataFrame) -> DataFrame:
    """The nearest of the candidates of every record; ties to the denser."""
    return stage(found.groupBy("uid").agg(F.min(F.struct("gap", "rank", "tie", "parent")).alias("v")).select("uid", "v.*"), "peaks-pointers")


def _roots(pointers: DataFrame) -> DataFrame:
    """``uid, root`` of every record that points somewhere.  Paths are followed among the records pointed to."""
    aims = pointers.select(F.col("parent").alias("uid")).distinct()
    path = stage(aims.join(pointers, "uid", "left").select("uid", F.coalesce("parent", "uid").alias("root")), "peaks-paths")
    last = path
    while True:  # pointer doubling, twice a round: paths shrink to a quarter, until none is left
        far = path.select(F.col("uid").alias("root"), F.col("root").alias("far"))
        two = path.join(far, "root").select("uid", F.col("root").alias("old"), F.col("far").alias("root"))
        two = two.join(far, "root").select("uid", "old", "root", "far")
        nxt = stage(two.select("uid", F.col("far").alias("root"), (F.col("far") != F.col("old")).alias("moved")), "peaks-paths")
        discard(last)
        last, path = nxt, nxt.select("uid", "root")
        if nxt.where("moved").isEmpty():
            break
    return pointers.join(path.withColumnRenamed("uid", "parent"), "parent").select("uid", "root")


def density_peaks(df: DataFrame, key: str, codes: str, radius: int) -> DataFrame:
    """``id, uid, root, density``: one row per record; ``root`` is the ``uid`` of its cluster's peak.

    Records are similar if they differ in at most ``radius`` of the sites known
    in both and share more known sites than that.  Density counts the other
    records that agree in a whole window of known sites; equal densities are
    ordered by a hash of key and codes.  Records of different lengths are
    padded with unknown sites.  Records with null keys or no known site form no
    cluster and are left out; repeated rows are members of one cluster; an
    empty table gives an empty result.
    """
    src = df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{codes}`").cast("array<int>").alias("_x")).where(F.col("_id").isNotNull() & F.exists("_x", lambda v: v.isNotNull()))
    id_type = src.schema["_id"].dataType.simpleString()
    s = _sites(src, radius)
    if s is None:
        return df.sparkSession.createDataFrame([], f"id {id_type}, uid bigint, root bigint, density bigint")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), s.pack(b.column(1))], names=["id", "codes"])

    points = src.mapInArrow(pack, f"id {id_type}, codes binary").select("id", F.monotonically_increasing_id().alias("uid"), F.xxhash64("id", "codes").alias("tie"), "codes")
    packed = stage(points, "peaks-packed")
    _settle(packed, s)
    points = stage(_densities(packed, s), "peaks-points")
    discard(packed)
    near = max(0, (radius - 1) // 2) if s.spared else radius
    found = _in_buckets(points.withColumn("asks", F.lit(True)), s, near, min(near + 1, s.sites) if s.spared else s.m, points.count())
    for extra in _with_apart(points, s):
        found = found.unionByName(extra)
    pointers = _nearest(found)
    if near < radius:
        open_ = stage(points.join(pointers, "uid", "left_anti"), "peaks-open")
        pointers = pointers.unionByName(_nearest(_in_full(points, open_, s)))
    roots = _roots(pointers)
    return stage(points.select("id", "uid", "density").join(roots, "uid", "left").select("id", "uid", F.coalesce("root", "uid").alias("root"), "density"), "peaks-members")


def labels(members: DataFrame) -> DataFrame:
    """``first_id, id``: every id with the least id of its cluster."""
    first = members.groupBy("root").agg(F.min("id").alias("first_id"))
    return members.join(first, "root").groupBy("id").agg(F.min("first_id").alias("first_id"))


def describe(members: DataFrame, typical: int = 3) -> DataFrame:
    """``first_id, n, typical``: size and most typical members (the densest; ties by id) of every cluster."""
    one = members.groupBy("root").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    ids = members.groupBy("root", "id").agg(F.max("density").alias("density"))
    w = Window.partitionBy("root").orderBy(F.desc("density"), "id")
    best = ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)  # limited within each task first
    top = best.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda v: v["id"]).alias("typical"))
    return one.join(top, "root").drop("root")
