"""Loading delimited lines while separating those that fail to parse.

The text of a whole Arrow batch is one byte buffer.  Structural indexing finds
its delimiters, quotes and record ends with numpy masks: the quote mask's
prefix sum gives, for every byte, how many quotes lie before it, and its
parity tells whether a byte is inside quotes.  Field boundaries, field counts
and type checks then work on integer positions, never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TAB, NEWLINE, QUOTE = 9, 10, 34

# Fixed values of the SAM format: required fields, operations, consuming operations.
SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
CIGAR_OPS = b"MIDNSHP=X"
READ_OPS = b"MIS=X"


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + col.offset + 1)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def quote_parity(buf: np.ndarray, offs: np.ndarray, quote: int = QUOTE) -> tuple[np.ndarray, np.ndarray]:
    """Quotes before each byte within its record, and whether the byte is inside quotes."""
    before = np.concatenate([[0], np.cumsum(buf == quote)])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = ((before[:-1] - before[offs[:-1]][row]) & 1).astype(bool)
    return before, inside


def split_records(buf: np.ndarray, quote: int = QUOTE, newline: int = NEWLINE) -> np.ndarray:
    """Record offsets of raw text whose quoted fields may hold line ends."""
    n = len(buf)
    _, inside = quote_parity(buf, np.array([0, n]), quote)
    ends = np.flatnonzero((buf == newline) & ~inside) + 1
    return np.concatenate([[0], ends, [n]]) if not len(ends) or ends[-1] != n else np.concatenate([[0], ends])


class Fields:
    """Field boundaries of every record of a buffer."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, delimiter: int = TAB, quoted_delimiters: bool = False):
        self.buf, self.offs = buf, offs
        self.n = len(offs) - 1
        mask = buf == delimiter
        self.quote = buf == QUOTE
        _, self.inside = quote_parity(buf, offs)
        if quoted_delimiters:
            mask &= ~self.inside
        self.at = np.flatnonzero(mask)
        self.first = np.searchsorted(self.at, offs)
        self.count = np.diff(self.first) + 1

    def span(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of field ``k`` (from 0); empty at the record's end where absent."""
        lo, has = self.first[:-1], self.count > k
        last = self.count - 1 == k
        at = np.append(self.at, 0)
        start = self.offs[:-1] if k == 0 else at[np.minimum(lo + k - 1, len(self.at))] + 1
        end = np.where(last, self.offs[1:], at[np.minimum(lo + k, len(self.at))])
        return np.where(has, start, self.offs[1:]), np.where(has, end, self.offs[1:])


def _prefix(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask)])


def _take(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buf[np.minimum(at, len(buf) - 1)] if len(buf) else np.zeros(len(at), np.uint8)


def _ints(digits: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """Values of all-digit spans, saturated at ``most + 1``; leading zeros are harmless."""
    value = np.zeros(len(start), np.int64)
    width = int((end - start).max()) if len(start) else 0
    for d in range(width):
        live = start + d < end
        step = np.minimum(value * 10 + _take(digits, start + d).astype(np.int64) - 48, most + 1)
        value = np.where(live, step, value)
    return value


def check_sam(col: pa.Array) -> tuple[np.ndarray, Fields, list[tuple[np.ndarray, np.ndarray]]]:
    """First failing check of each line: '' valid, 'header', else the reject reason."""
    buf, offs = text_buffer(col)
    f = Fields(buf, offs)
    n = f.n
    reason = np.full(n, "", dtype=object)
    open_ = np.ones(n, bool)

    def fail(bad: np.ndarray, why: str) -> None:
        hit = open_ & bad
        reason[hit] = why
        open_[hit] = False

    length = np.diff(offs)
    fail((length > 0) & (_take(buf, offs[:-1]) == 64), "header")

    # columns: every field after the eleventh must start like XX:T:
    fail(f.count < len(SAM_FIELDS), "columns")
    lower = buf | 32
    alpha = (lower >= 97) & (lower <= 122)
    digit = (buf >= 48) & (buf <= 57)
    rows = np.repeat(np.arange(n), f.count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(f.count) - f.count, f.count)
    tag = (nth >= len(SAM_FIELDS)) & open_[rows]
    trow, tk = rows[tag], nth[tag]
    if len(trow):
        start = f.at[f.first[trow] + tk - 1] + 1
        idx = f.first[trow] + tk
        end = np.where(tk == f.count[trow] - 1, offs[trow + 1], np.append(f.at, 0)[np.minimum(idx, len(f.at))])
        good = (
            (end - start >= 5)
            & _take(alpha, start)
            & (_take(alpha, start + 1) | _take(digit, start + 1))
            & (_take(buf, start + 2) == 58)
            & _take(alpha, start + 3)
            & (_take(buf, start + 4) == 58)
        )
        bad = np.zeros(n, bool)
        bad[trow[~good]] = True
        fail(bad, "columns")

    # quoting: fields 1 to 9 hold no quote, or one that opens at their start and one that closes at their end
    spans = [f.span(k) for k in range(len(SAM_FIELDS))]
    bad = np.zeros(n, bool)
    even, odd = _prefix(f.quote & ~f.inside), _prefix(f.quote & f.inside)  # quotes by the parity of those before them
    for k in range(9):
        s, e = spans[k]
        flip = _take(f.inside, s)  # a stray quote in an earlier field turns the parity
        x, y = even[e] - even[s], odd[e] - odd[s]
        opens, shuts = np.where(flip, y, x), np.where(flip, x, y)
        last = np.maximum(e - 1, 0)
        wrapped = (opens == 1) & (shuts == 1) & _take(f.quote, s) & _take(f.quote, last) & (_take(f.inside, last) != flip)
        bad |= (opens + shuts > 0) & ~wrapped
        spans[k] = (np.where(wrapped, s + 1, s), np.where(wrapped, e - 1, e))
    fail(bad, "quoting")

    digits_before = _prefix(digit)
    s, e = spans[1]
    is_int = (e > s) & (digits_before[e] - digits_before[s] == e - s)
    flag = np.zeros(n, np.int64)
    flag[is_int] = _ints(buf, s[is_int], e[is_int], 65535)
    fail(~is_int | (flag > 65535), "flag")

    # cigar: digits then one operation, repeated; read length equals the sequence
    mapped = open_ & ((flag & 4) == 0)
    ok, want = _cigar_spans(buf, *spans[5], mapped)
    s, e = spans[9]
    seq_len = _chars(buf, s, e)
    star = (e - s == 1) & (_take(buf, s) == 42)
    fail(mapped & (~ok | (~star & (want != seq_len))), "cigar")
    return reason, f, spans


def _chars(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Characters (not bytes) of each span of UTF-8 text."""
    heads = _prefix((buf & 0xC0) != 0x80)
    return heads[e] - heads[s]


def _cigar_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Well-formedness and read length of CIGAR spans, all at once."""
    n = len(s)
    ok, want = np.zeros(n, bool), np.zeros(n, np.int64)
    rows = np.flatnonzero(use & (e > s))
    if not len(rows):
        return ok, want
    lens = e[rows] - s[rows]
    base = np.cumsum(lens) - lens
    flat = buf[np.repeat(s[rows] - base, lens) + np.arange(lens.sum())]
    owner = np.repeat(np.arange(len(rows)), lens)
    is_op = np.isin(flat, np.frombuffer(CIGAR_OPS, np.uint8))
    is_digit = (flat >= 48) & (flat <= 57)
    prev_digit = np.concatenate([[False], is_digit[:-1]])
    prev_digit[base] = False
    good = is_digit | (is_op & prev_digit)
    fine = np.bincount(owner, weights=~good, minlength=len(rows)) == 0
    fine &= is_op[base + lens - 1]
    at = np.flatnonzero(is_op & fine[owner])
    if len(at):
        start = np.concatenate([[0], at[:-1] + 1])
        start = np.maximum(start, base[owner[at]])
        count = _ints(flat, start, at, 1 << 40)
        takes = np.isin(flat[at], np.frombuffer(READ_OPS, np.uint8))
        got = np.zeros(len(rows), np.int64)
        np.add.at(got, owner[at], np.where(takes, count, 0))
        want[rows] = got
    ok[rows] = fine
    return ok, want


def _texts(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.Array:
    """Spans of the buffer as a string column, gathered at once."""
    lens = e - s
    offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    flat = buf[np.repeat(s - offs[:-1], lens) + np.arange(offs[-1])]
    return pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(offs.tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())


def reject_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``reason`` of every line that cannot be loaded.

    Header lines (``@``) are neither valid nor rejected.  A null or empty line
    has one empty field, hence reason ``columns``; very long lines and repeated
    lines are handled as any other; an empty table gives no rows.
    """
    src = df.select(*[f"`{c}`" for c in keep], f"`{text}`")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)]) + ", reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reason, _, _ = check_sam(b.column(len(keep)))
            take = pa.array(np.flatnonzero((reason != "") & (reason != "header")))
            cols = [b.column(i).take(take) for i in range(len(keep))]
            cols.append(pa.array(reason[take.to_numpy()], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "reason"])

    return src.mapInArrow(run, schema)


def load_lines(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Valid lines as typed alignment columns, one row per line.

    ``keep`` columns come first; fields 1 to 9 have lost enclosing quotes; a
    position or number that is no integer becomes null; ``*`` stays ``*``.
    Lines of :func:`reject_lines` and header lines are left out.
    """
    src = df.select(*[f"`{c}`" for c in keep], f"`{text}`")
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[: len(keep)])
    raw = ", ".join(f"{c} string" for c in SAM_FIELDS) + ", tags string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            reason, f, spans = check_sam(b.column(len(keep)))
            rows = np.flatnonzero(reason == "")
            cols = [b.column(i).take(pa.array(rows)) for i in range(len(keep))]
            cols += [_texts(f.buf, s[rows], e[rows]) for s, e in spans]
            ends, stop = spans[10][1][rows], f.offs[rows + 1]
            tags = _texts(f.buf, np.minimum(ends + 1, stop), stop)
            cols.append(pc.if_else(pc.equal(pc.binary_length(tags), 0), pa.scalar(None, pa.string()), tags))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *SAM_FIELDS, "tags"])

    out = src.mapInArrow(run, f"{head}, {raw}" if keep else raw)
    ints = {"flag": "int", "pos": "bigint", "mapq": "int", "pnext": "bigint", "tlen": "int"}
    return out.selectExpr(*[f"`{c}`" for c in keep], *[f"try_cast({c} as {ints[c]}) as {c}" if c in ints else c for c in SAM_FIELDS], "tags")
