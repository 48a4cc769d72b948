"""Evaluation passages inside a training corpus.

The test items form a BM25 inverted index over word n-grams, with postings in
blocks that know their greatest score.  Every training passage is a query, and
block-max WAND retrieves all items whose score reaches the item's threshold.
That threshold is the least score any run of ``min_words`` words of the item
can have, so a passage holding such a run is always retrieved; retrieved pairs
are then verified word by word, and the overlap with the item's question is
reported beside each leak.

Items beyond :data:`MAX_ITEMS` are divided into shards.  The corpus is still
read once: a fixed-size bitmap of all items' n-grams keeps the passages that
can hold a run of any item, and only those are searched shard by shard.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.storage import small, stage

WORD = re.compile(r"[a-z0-9]+")
MAX_ITEMS = 20_000  # items of one index shard; more items make more shards
BITS = 1 << 27  # bitmap of all items' n-grams where there are several shards: a fixed size


def words(text: str | None) -> list[str]:
    """Longest runs of a-z and 0-9 of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def hashed_grams(ids: np.ndarray, n: int) -> np.ndarray:
    """63-bit keys of the runs of ``n`` ids, whatever the number of ids; colliding keys only add candidates."""
    key = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
    for j in range(n if len(key) else 0):
        key = (key ^ ids[j : len(ids) - n + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(1)).astype(np.int64)


class ItemIndex:
    """BM25 inverted index of test items with block maxima; scores are divided by each item's threshold."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 12, n: int = 3, k1: float = 1.2, b: float = 0.75, block: int = 8):
        self.min_words, self.n = min_words, n
        self.span = min_words - n + 1  # n-grams of the shortest run that counts
        kept = [(i, w) for i, t in items if len(w := words(t)) >= min_words]
        self.ids = np.array([i for i, _ in kept], np.int64)
        self.vocab: dict[str, int] = {}
        docs = [np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int64) for _, w in kept]
        grams = [self.grams(d) for d in docs]
        self.keys = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        terms = [np.searchsorted(self.keys, g) for g in grams]
        df = np.bincount(np.concatenate([np.unique(t) for t in terms]), minlength=len(self.keys)) if terms else np.zeros(0)
        idf = np.log1p((len(kept) - df + 0.5) / (df + 0.5))
        mean = np.mean([len(t) for t in terms]) if terms else 1.0
        post: list[list[tuple[int, float]]] = [[] for _ in self.keys]
        self.runs: list[set[bytes]] = []
        for x, (d, t) in enumerate(zip(docs, terms)):
            tf = dict(zip(*np.unique(t, return_counts=True)))
            norm = k1 * (1 - b + b * len(t) / mean)
            w = {k: idf[k] * v * (k1 + 1) / (v + norm) for k, v in tf.items()}
            least = min(sum(w[k] for k in set(t[a : a + self.span].tolist())) for a in range(len(t) - self.span + 1))
            for k, v in w.items():
                post[k].append((x, v / least))
            self.runs.append({d[a : a + min_words].tobytes() for a in range(len(d) - min_words + 1)})
        self.docs = [[x for x, _ in p] for p in post]
        self.scores = [[s for _, s in p] for p in post]
        self.block = block
        self.block_max = [[max(s[a : a + block]) for a in range(0, len(s), block)] for s in self.scores]
        self.block_last = [[d[min(a + block, len(d)) - 1] for a in range(0, len(d), block)] for d in self.docs]
        self.top = np.array([max(s) for s in self.scores]) if post else np.zeros(0)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Keys of the word n-grams; 0 ids (unknown words) make a key that no item has."""
        key = hashed_grams(ids, self.n)
        for j in range(self.n if len(key) else 0):
            key[ids[j : len(ids) - self.n + 1 + j] == 0] = -1
        return key

    def retrieve(self, terms: list[int], floor: float = 1 - 1e-9) -> list[int]:
        """Block-max WAND: all items whose summed score reaches the threshold."""
        end, out = len(self.ids), []
        cur = [[0, t] for t in terms]  # cursor, term
        at = lambda c: self.docs[c[1]][c[0]] if c[0] < len(self.docs[c[1]]) else end
        while True:
            cur = [c for c in cur if c[0] < len(self.docs[c[1]])]
            cur.sort(key=at)
            bound, pivot = 0.0, -1
            for i, c in enumerate(cur):
                bound += self.top[c[1]]
                if bound >= floor:
                    pivot = i
                    break
            if pivot < 0:
                return out
            doc = at(cur[pivot])
            while pivot + 1 < len(cur) and at(cur[pivot + 1]) == doc:
                pivot += 1
            # shallow move: the blocks that would hold the pivot item
            bound, reach = 0.0, at(cur[pivot + 1]) if pivot + 1 < len(cur) else end
            for c in cur[: pivot + 1]:
                lasts, k = self.block_last[c[1]], c[0] // self.block
                while k < len(lasts) and lasts[k] < doc:
                    k += 1
                if k < len(lasts):
                    bound += self.block_max[c[1]][k]
                    reach = min(reach, lasts[k] + 1)
            if bound < floor:
                goal = max(reach, doc + 1)  # no item before the nearest block end can reach the threshold
            elif at(cur[0]) == doc:
                if sum(self.scores[c[1]][c[0]] for c in cur[: pivot + 1]) >= floor:
                    out.append(doc)
                goal = doc + 1
            else:
                goal = doc
            for c in cur[: pivot + 1]:
                lasts, k = self.block_last[c[1]], c[0] // self.block
                while k < len(lasts) and lasts[k] < goal:
                    k += 1
                c[0] = max(c[0], k * self.block)
                ds = self.docs[c[1]]
                while c[0] < len(ds) and ds[c[0]] < goal:
                    c[0] += 1


def search(index: ItemIndex, texts: list[str | None], passage: int = 48) -> list[tuple[int, int]]:
    """``(text number, item number)`` of every verified leak in a batch of texts.

    Each text is cut into passages of ``passage`` words that overlap by one
    word less than the shortest run, so no run is lost between passages.
    """
    stride = passage - index.min_words + 1
    get, ids, lens = index.vocab.get, [], []
    for t in texts:
        w = words(t)
        ids.extend([get(x, 0) for x in w])
        ids.append(0)  # texts never join
        lens.append(len(w) + 1)
    flat = np.array(ids, np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    keys = index.grams(flat)
    if not len(keys) or not len(index.keys):
        return []
    pos = np.flatnonzero(keys >= 0)
    spot = np.minimum(np.searchsorted(index.keys, keys[pos]), len(index.keys) - 1)
    hit = index.keys[spot] == keys[pos]
    pos, term = pos[hit], spot[hit]
    text = np.searchsorted(starts, pos, side="right") - 1
    local = pos - starts[text]
    per_text = -(-np.array(lens, np.int64) // stride) + 1
    first = np.concatenate([[0], np.cumsum(per_text)])
    hi = local // stride  # the last passage holding the n-gram, and the earlier ones that reach it
    found: set[tuple[int, int]] = set()
    parts_p, parts_t = [], []
    for back in range(-(-passage // stride)):
        p = hi - back
        ok = (p >= 0) & (local + index.n <= p * stride + passage)
        parts_p.append(first[text[ok]] + p[ok])
        parts_t.append(term[ok])
    code = np.sort(np.concatenate(parts_p) * np.int64(len(index.keys)) + np.concatenate(parts_t))
    code = code[np.concatenate([[True], code[1:] != code[:-1]])[: len(code)]]
    pas, term = code // len(index.keys), code % len(index.keys)
    edge = np.flatnonzero(np.diff(pas, prepend=-1))
    if not len(edge):
        return []
    bound = np.add.reduceat(index.top[term], edge)  # WAND's first test, for all passages at once
    ends = np.append(edge[1:], len(pas))
    for a, z in zip(edge[bound >= 1 - 1e-9], ends[bound >= 1 - 1e-9]):
        got = index.retrieve(term[a:z].tolist())
        if not got:
            continue
        t = int(np.searchsorted(first, pas[a], side="right") - 1)
        lo = starts[t] + (pas[a] - first[t]) * stride
        run = flat[lo : min(lo + passage, starts[t + 1])]
        held = {run[k : k + index.min_words].tobytes() for k in range(len(run) - index.min_words + 1)}
        found.update((t, x) for x in got if not held.isdisjoint(index.runs[x]))
    return sorted(found)


def _word_ids(text: str | None, seen: dict[str, int]) -> np.ndarray:
    out = []
    for x in words(text):
        if x not in seen:
            if len(seen) > 1_000_000:
                seen.clear()
            seen[x] = zlib.crc32(x.encode())
        out.append(seen[x])
    return np.array(out, np.uint64)


def _promising(src: DataFrame, items: DataFrame, min_words: int, n: int, passage: int) -> DataFrame:
    """Passages of ``src`` (key, text) in which every n-gram of some run of ``min_words`` words occurs in the items."""
    width, span = BITS // 256 // 8, min_words - n + 1
    key, text = src.columns

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.zeros(BITS, bool), {}
        for b in batches:
            for t in b.column(0).to_pylist():
                bits[hashed_grams(_word_ids(t, seen), n) & (BITS - 1)] = True
        packed = np.packbits(bits).reshape(256, width)
        at = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([zlib.compress(packed[i].tobytes(), 1) for i in at], pa.binary())], names=["block", "bits"])

    def join(t: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        for x in t.column("bits").to_pylist():
            bits |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.Table.from_arrays([t.column("block").slice(0, 1), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["block", "bits"])

    got = items.mapInArrow(mark, "block int, bits binary").groupBy("block").applyInArrow(join, "block int, bits binary").collect()  # 256 rows of fixed size
    table = np.zeros((256, width), np.uint8)
    for r in got:
        table[r["block"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    shared = src.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, {}
        for b in batches:
            row, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = words(t)
                k = hashed_grams(_word_ids(t, seen), n) & (BITS - 1)
                held = np.concatenate([[0], np.cumsum((bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1)])
                start = np.flatnonzero(held[span:] - held[:-span] == span) if len(held) > span else []
                for p in np.unique(np.asarray(start, np.int64) // (passage - min_words + 1)):
                    lo = p * (passage - min_words + 1)
                    row.append(i), out.append(" ".join(w[lo : lo + passage]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.string())], names=[key, text])

    return stage(src.mapInArrow(keep, src.schema), "leak-passages")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
          item_text: str = "item_text", min_words: int = 12, n: int = 3, passage: int = 48) -> DataFrame:
    """``key, item_key`` of every document holding ``min_words`` consecutive words of an item.

    Null and empty texts hold nothing; items shorter than ``min_words`` words
    cannot leak; items sharing a passage are all reported; repeated documents
    give one row per key and item.  Documents are processed whole.  The items
    must be few enough for a shard (:data:`MAX_ITEMS`, checked); beyond that
    they are divided by hash into shards, each searched in turn in the passages
    one pass over the corpus has kept.
    """
    spark = docs.sparkSession
    picked = items.select(F.col(f"`{item_key}`"), F.col(f"`{item_text}`")).distinct()
    rows, shards = small(picked, MAX_ITEMS), 1
    if rows is None:
        shards = -(-picked.count() * 5 // (4 * MAX_ITEMS))
    src = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    if len(src.columns) < 2:
        raise ValueError("key and text must differ")
    if shards > 1:
        src = _promising(src, picked.select(F.col(f"`{item_text}`")), min_words, n, passage)
    schema = f"`{key}` {src.schema[0].dataType.simpleString()}, `{item_key}` {picked.schema[0].dataType.simpleString()}"
    out = None
    for s in range(shards):
        part = rows if rows is not None else picked.where(F.pmod(F.xxhash64(item_key), F.lit(shards)) == s).collect()
        index = ItemIndex([(k, t) for k, (_, t) in enumerate(part)], min_words, n)
        keys = [r[0] for r in part]
        shared = spark.sparkContext.broadcast((index, keys))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, keys = shared.value
            for b in batches:
                for a in range(0, b.num_rows, 2000):
                    c = b.slice(a, 2000)
                    got = search(index, c.column(1).to_pylist(), passage)
                    if got:
                        at = c.column(0).take(pa.array([t for t, _ in got]))
                        yield pa.RecordBatch.from_arrays([at, pa.array([keys[index.ids[x]] for _, x in got])], names=[key, item_key])

        found = src.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def question_overlap(found: DataFrame, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", question: str = "question") -> DataFrame:
    """``key, item_key, question_words, question_shared`` of every leak: distinct words of the item's question, and those in the document.

    A null or empty question has no words; of repeated documents or items the
    greatest overlap counts.
    """

    def distinct(c: str):
        return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "), " ")), "")

    d = docs.select(F.col(f"`{key}`").alias("_d"), F.col(f"`{text}`").alias("_t")).join(found.select(F.col(f"`{key}`").alias("_d")).distinct(), "_d", "left_semi")
    i = items.select(F.col(f"`{item_key}`").alias("_i"), distinct(f"`{question}`").alias("_q"))
    j = found.select(F.col(f"`{key}`").alias("_d"), F.col(f"`{item_key}`").alias("_i")).join(i, "_i").join(d.select("_d", distinct("_t").alias("_w")), "_d")
    g = j.groupBy("_d", "_i").agg(F.max(F.struct(F.size(F.array_intersect("_q", "_w")).alias("s"), F.size("_q").alias("n"))).alias("v"))
    return g.select(F.col("_d").alias(key), F.col("_i").alias(item_key), F.col("v.n").alias("question_words"), F.col("v.s").alias("question_shared"))
