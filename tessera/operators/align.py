"""Pairwise alignment in Arrow batches, and merging of read pairs.

Dynamic programming can't be written as column expressions; each batch row is
filled anti-diagonal-free, one numpy row at a time.  Ties go up, then left,
then diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions.seq import IUPAC, reverse_complement

GAP = ord("-")


def _scores(a: np.ndarray, b: np.ndarray, match: float, mismatch: float, profile: bool) -> np.ndarray:
    if profile:
        mask = np.zeros(256, np.int64)
        for k, v in IUPAC.items():
            mask[ord(k)] = v
        same = (mask[a][:, None] & mask[b][None, :]) != 0
    else:
        same = a[:, None] == b[None, :]
    return np.where(same, match, mismatch)


def global_align(a: str, b: str, match: float = 1, mismatch: float = -2, gap: float = -2, band: int = -1,
                 free_ends: bool = False, profile: bool = False, scores: np.ndarray | None = None) -> tuple[str, str, float]:
    """Needleman-Wunsch alignment of ``a`` and ``b``: both with gaps, and the score.

    ``band`` limits the distance from the diagonal (-1: none).  ``free_ends``
    makes leading and trailing gaps cost nothing.  ``profile`` compares
    ambiguity codes by shared bases.  ``scores`` replaces the letter scores.
    """
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    n, m = len(x), len(y)
    s = _scores(x, y, match, mismatch, profile) if scores is None else scores
    h = np.full((n + 1, m + 1), -np.inf)
    h[0] = 0 if free_ends else gap * np.arange(m + 1)
    h[:, 0] = 0 if free_ends else gap * np.arange(n + 1)
    cols = np.arange(1, m + 1)
    for i in range(1, n + 1):
        up_gap = np.where(free_ends & (cols == m), 0.0, gap)
        best = np.maximum(h[i - 1, :-1] + s[i - 1], h[i - 1, 1:] + up_gap)
        step = 0.0 if free_ends and i == n else gap
        if band >= 0:
            best = np.where(np.abs(i - cols) <= band, best, -np.inf)
        # left moves: h[j] = max over k <= j of best[k] + step * (j - k)
        run = np.maximum.accumulate(np.concatenate([[h[i, 0]], best]) - step * np.arange(m + 1))
        row = run + step * np.arange(m + 1)
        h[i, 1:] = row[1:] if band < 0 else np.where(np.abs(i - cols) <= band, row[1:], -np.inf)
    i, j, p, q = n, m, [], []
    while i or j:
        up = 0.0 if free_ends and j in (0, m) else gap
        left = 0.0 if free_ends and i in (0, n) else gap
        if i and np.isclose(h[i, j], h[i - 1, j] + up):
            i -= 1
            p.append(x[i]), q.append(GAP)
        elif j and np.isclose(h[i, j], h[i, j - 1] + left):
            j -= 1
            p.append(GAP), q.append(y[j])
        else:
            i, j = i - 1, j - 1
            p.append(x[i]), q.append(y[j])
    return bytes(p[::-1]).decode(), bytes(q[::-1]).decode(), float(h[n, m])


def align_pairs(df: DataFrame, keys: list[str], a: str, b: str, **options) -> DataFrame:
    """``keys, aligned_a, aligned_b, score`` of each row's two sequences; null where either is null."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [global_align(x, y, **options) if x is not None and y is not None else (None, None, None) for x, y in zip(pdf[a], pdf[b])]
            out = pdf[keys].copy()
            out["aligned_a"], out["aligned_b"], out["score"] = ([g[i] for g in got] for i in range(3))
            yield out

    return df.select(*keys, a, b).mapInPandas(run, f"{types}, aligned_a string, aligned_b string, score double")


def align_to_reference(reads: DataFrame, reference: str, keys: list[str], column: str = "seq", **options) -> DataFrame:
    """Every read aligned to one reference sequence."""
    return align_pairs(reads.withColumn("_ref", F.lit(reference)), keys, column, "_ref", **options)


def _merge(s1: str, q1: str, s2: str, q2: str, gap: float) -> tuple[str, str, int]:
    """Consensus of a forward read and the reversed mate: most probable base of every overlapping place."""
    e = {c: 10 ** (-(c - 33) / 10) for c in range(33, 127)}
    x, y, _ = global_align(s1, s2, 2, -3, gap, free_ends=True)
    i = j = over = 0
    seq, qual = [], []
    for a, b in zip(x, y):
        if a != "-" and b != "-":
            p = np.array([(1 - e[ord(q1[i])] if c == a else e[ord(q1[i])] / 3) * (1 - e[ord(q2[j])] if c == b else e[ord(q2[j])] / 3) for c in "ACGT"])
            p /= p.sum()
            k = int(p.argmax())
            seq.append("ACGT"[k])
            qual.append(chr(33 + int(min(93, round(-10 * np.log10(max(1 - p[k], 1e-10)))))))
            i, j, over = i + 1, j + 1, over + 1
        elif a != "-":
            seq.append(a), qual.append(q1[i])
            i += 1
        else:
            seq.append(b), qual.append(q2[j])
            j += 1
    return "".join(seq), "".join(qual), over


def merge_pairs(first: DataFrame, second: DataFrame, name: str = "name", gap: float = -7) -> DataFrame:
    """``name, seq, qual, overlap`` of read pairs merged over their overlap.

    The mate is reverse-complemented and aligned with free ends; pairs without
    a mate, or with an empty or null read, are left out.
    """
    m = second.select(name, reverse_complement(F.upper("seq")).alias("s2"), F.reverse("qual").alias("q2"))
    j = first.select(name, F.upper("seq").alias("s1"), F.col("qual").alias("q1")).join(m, name).where("length(s1) > 0 and length(s2) > 0 and length(s1) = length(q1) and length(s2) = length(q2)")
    kind = first.schema[name].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [_merge(*r, gap) for r in zip(pdf["s1"], pdf["q1"], pdf["s2"], pdf["q2"])]
            yield pd.DataFrame({name: pdf[name], "seq": [g[0] for g in got], "qual": [g[1] for g in got], "overlap": [g[2] for g in got]})

    return j.mapInPandas(run, f"`{name}` {kind}, seq string, qual string, overlap int")
