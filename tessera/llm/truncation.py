"""Text values cut by a field limit or a broken transfer.

Per source and column, histograms of the stored lengths (characters and bytes)
are tested for spikes: a field limit shows as many values of exactly one great
length, however long a few stray values are.  Values at a spike that do not
close were cut by the limit; a second rule, for cuts in transfer, which happen
at any length, reports values off the spikes that do not close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.storage import stage

# Blanks, what may follow a closing mark, and complete closing lines.
BLANKS = " \t\n\x0b\f\r"
CLOSERS = "\"'”’»)]}"
SENTENCE_MARKS = [".", "?", "!"]
LEFT_OUT = r"(\.\s?\.\s?\.|…)[\"'”’»)\]}.]*$"
CLOSING_LINES = [
    r"-- \S.*",
    r"\|.*\|",
    r"(Keywords|Files): *\S.*",
    r"exit (status|code) -?\d+",
    r"finished in \d+(\.\d+)? (ms|s|m|h|min)",
]
LOG_LINE, LOG_END = r"^(finished in|exit (status|code))\b", rf"^({CLOSING_LINES[3]}|{CLOSING_LINES[4]})$"
FENCE = r"(?m)^[ \t]*```"


def canonical_source(c: Column) -> Column:
    """Source names equal but for case, outer blanks and ``_ - blank`` between words."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def closes(text: Column, closing_lines: list[str] = CLOSING_LINES) -> Column:
    """Whether a text ends with a closed sentence or a complete closing line.

    Null or blank text gives null.  Blanks at the end don't count; dots that
    stand for left-out text close nothing; a fence counts only if it closes an
    open one.  Patterns see the last lines only, so a text costs its end; the
    fences of a whole text are counted where its last line is one.
    """
    v = F.rtrim(text)
    u = F.when(F.right(v, F.lit(1)).isin(*BLANKS[1:]), F.rtrim(v, F.lit(BLANKS))).otherwise(v)
    last = F.substring_index(u, "\n", -1)
    three = F.substring_index(u, "\n", -3)  # three dots with one blank between them span three lines at most
    line = F.lit(False)
    for pattern in closing_lines:
        line = line | last.rlike(f"^{pattern}$")
    fence = F.when(last.rlike(r"^[ \t]*```$"), F.size(F.split(u, FENCE)) % 2 == 1).otherwise(False)
    # a log's last line closes only when it is complete, so "finished in 64." does not
    broken_log = last.rlike(LOG_LINE) & ~last.rlike(LOG_END)
    marked = F.right(F.rtrim(last, F.lit(CLOSERS)), F.lit(1)).isin(*SENTENCE_MARKS)
    sentence = F.when(marked, ~three.rlike(LEFT_OUT) & ~broken_log).otherwise(False)
    return F.when(text.rlike(r"\S"), sentence | line | fence)


def spikes(values: DataFrame, min_count: int = 5, factor: float = 8.0) -> DataFrame:
    """``source, field, unit, length, n`` of every spike of the length histograms.

    A length is a spike if at least ``min_count`` values have it and they are
    ``factor`` times the mean count of the other occupied lengths within its
    octave and the ones beside it.  One partial aggregation; only histograms
    move, and a hot source is one histogram like any other.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("_k")
    hist = values.select("source", "field", kinds).groupBy("source", "field", F.col("_k.unit").alias("unit"), F.col("_k.length").alias("length")).agg(F.count("*").alias("n"))
    hist = stage(hist.withColumn("octave", F.length(F.bin("length"))), "truncation-lengths")
    total = hist.groupBy("source", "field", "unit", "octave").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    near = total.withColumn("octave", F.explode(F.array(F.col("octave") - 1, F.col("octave"), F.col("octave") + 1)))
    near = near.groupBy("source", "field", "unit", "octave").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    mean = F.when(F.col("_k") > 1, (F.col("_n") - F.col("n")) / (F.col("_k") - 1)).otherwise(0.0)
    found = hist.where(F.col("n") >= min_count).join(near, ["source", "field", "unit", "octave"]).where(F.col("n") >= factor * mean)
    return found.select("source", "field", "unit", "length", "n")


def truncated(docs: DataFrame, key: str = "doc_id", text: str | list[str] = "text", source: str = "source") -> DataFrame:
    """One row per text value: ``_id, source, field, chars, bytes, closed, limits_chars, limits_bytes, cause``.

    ``text`` names one or several columns, each tested on its own.  ``cause``
    is ``field_limit`` (at a spike length and not closed), ``transfer`` (not
    closed elsewhere) or null (whole); the limits are the spike lengths of the
    source and column.  Null and blank texts are left out; a null source is the
    source ``''``; repeated rows are repeated values; a source without a spike
    has null limits.
    """
    origin = F.coalesce(canonical_source(F.col(f"`{source}`")), F.lit("")).alias("source")
    parts = []
    for c in [text] if isinstance(text, str) else text:
        t = F.col(f"`{c}`")
        parts.append(docs.where(t.rlike(r"\S")).select(F.col(f"`{key}`").alias("_id"), origin, F.lit(c).alias("field"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), closes(t).alias("closed")))
    m = parts[0]
    for p in parts[1:]:
        m = m.unionByName(p)
    m = stage(m, "truncation")
    limits = spikes(m).groupBy("source", "field").agg(*[F.array_sort(F.collect_set(F.when(F.col("unit") == u, F.col("length")))).alias(f"limits_{u}") for u in ("chars", "bytes")])
    both = m.join(limits, ["source", "field"], "left")
    at = F.coalesce(F.array_contains("limits_chars", F.col("chars")), F.lit(False)) | F.coalesce(F.array_contains("limits_bytes", F.col("bytes")), F.lit(False))
    return both.withColumn("cause", F.when(~F.col("closed"), F.when(at, "field_limit").otherwise("transfer")))


def rates(found: DataFrame) -> DataFrame:
    """How often each source cuts each column, by cause, with the lengths of its limits."""
    n = F.count("*")
    cut = F.count_if(F.col("cause").isNotNull())
    return found.groupBy("source", "field").agg(
        n.alias("n_docs"), cut.alias("n_cut"), F.count_if(F.col("cause") == "field_limit").alias("n_field_limit"),
        F.round(cut / n, 6).alias("cut_share"),
        *[F.coalesce(F.array_join(F.max(f"limits_{u}"), ","), F.lit("")).alias(f"limits_{u}") for u in ("chars", "bytes")],
    )
