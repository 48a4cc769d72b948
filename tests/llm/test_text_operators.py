"""Text and similarity operators against brute force on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import leakage, mixing, nearcopies, percentiles, similarity, truncation


def _components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _observations(rng, clusters, sites=40, edits=3):
    rows = []
    for size in clusters:
        centre = [rng.randrange(4) for _ in range(sites)]
        for _ in range(size):
            x = list(centre)
            for i in rng.sample(range(sites), rng.randint(0, edits)):
                x[i] = rng.randrange(4)
            for i in rng.sample(range(sites), rng.randint(0, 2)):
                x[i] = None
            rows.append(x)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [8192, 16])
def test_density_peaks_split_hot_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(similarity, "CHUNK", chunk)
    rng = random.Random(5)
    rows = _observations(rng, [60, 20, 5, 2, 1, 1, 1])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)] + [(900, None), (901, [None] * 40)], "k bigint, x array<int>").repartition(3)
    members = similarity.density_peaks(df, "k", "x", 6)
    got = {r["id"]: r["first_id"] for r in similarity.labels(members).collect()}
    far = lambda a, b: sum(p != q for p, q in zip(a, b) if p is not None and q is not None)
    want = _components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if far(rows[i], rows[j]) <= 6])
    assert got == dict(enumerate(want))
    top = {r["first_id"]: r for r in similarity.describe(members).collect()}
    assert sorted(r["n"] for r in top.values()) == [1, 1, 1, 2, 5, 20, 60]
    assert all(want[t] == f for f, r in top.items() for t in r["typical"])


def test_density_peaks_edge_cases(spark):
    none = spark.createDataFrame([], "k bigint, x array<int>")
    assert similarity.labels(similarity.density_peaks(none, "k", "x", 2)).count() == 0
    wide = spark.createDataFrame([(1, [1000, -5, 7, 8]), (2, [1000, -5, 7, 8]), (3, [1000, -5, 7]), (3, [1000, -5, 7]), (4, [1, 2, 3, 4])], "k bigint, x array<int>")
    got = {r["id"]: r["first_id"] for r in similarity.labels(similarity.density_peaks(wide, "k", "x", 1)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_percentiles_stay_within_the_bound(spark):
    df = spark.range(200_000).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") * 7919 % 100_003).alias("v"), (F.col("id") % 9).alias("day"))
    df = df.unionByName(spark.createDataFrame([(None, 5, 1), (True, None, 1)], "g boolean, v bigint, day bigint"))
    daily = percentiles.sketch(df, ["g", "day"], "v", 400)
    for s in (percentiles.sketch(df, ["g"], "v", 400), percentiles.merge(daily, ["g"], k=400)):
        for r in percentiles.percentiles(s, ["g"], {"p50": 0.5, "p99": 0.99}).collect():
            if r["g"] is None:
                assert r["p50"] == 5
                continue
            v = np.sort(df.where(F.col("g") == r["g"]).where("v is not null").toPandas()["v"].to_numpy())
            assert r["n_values"] == len(v)
            for q in (0.5, 0.99):
                at = np.searchsorted(v, r["p50"] if q == 0.5 else r["p99"], side="right") / len(v)
                assert abs(at - q) <= percentiles.rank_error(400)
    x = spark.createDataFrame([(1, 0.5), (1, float("nan")), (1, 2.5)], "g int, v double")
    assert percentiles.percentiles(percentiles.sketch(x, ["g"], "v"), ["g"], {"hi": 1.0}, "double").first()["hi"] == 2.5
    assert percentiles.sketch(x.where("false"), ["g"], "v").count() == 0


def _sequences(rng):
    out = []
    for _ in range(25):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(30, 140)))
        out.append(s)
        for _ in range(rng.randint(0, 4)):
            x = list(s)
            for _ in range(rng.randint(1, 7)):
                i = rng.randrange(len(x))
                x[i] = rng.choice(["A", "C", "G", "T", "", "AC"])
            t = "".join(x)
            cut = rng.randrange(1, len(t))
            out.append(t[cut:] + t[:cut] if rng.random() < 0.4 else t[rng.randrange(len(t) // 3) :])
    return out + ["ACGTACGTACG", "ACGTACGTACGA", "AAAA", "", out[0], "N" * 60, "N" * 80]


@pytest.mark.parametrize("shares", [None, [0.3, 0.6, 0.1, 0], [0.1, 0.4, 0.5, 0], [0, 0.5, 0.2, 0.3], [0, 0.2, 0.1, 0.7], [0, 0, 0, 1]])
def test_near_copies_equal_brute_force(spark, monkeypatch, shares):
    """Whatever class a token has (single, pair, triple, hot), no similar pair is missed."""
    rng = random.Random(11)
    seqs = _sequences(rng)
    table = nearcopies.token_table

    def classes(uniq, k):
        cls, least, total = table(uniq, k)
        if shares is not None:
            r = np.random.default_rng(3)
            cls = {f: r.choice([1, 2, 3, 4], nearcopies.SLOTS, p=shares).astype(np.uint8) for f in cls}
        return cls, least, total

    monkeypatch.setattr(nearcopies, "token_table", classes)
    rows = [(i % 2, i // 2, s) for i, s in enumerate(seqs)] + [(0, 3, "ACGTACGTACGTTT"), (0, None, "A" * 30), (1, 4, None)]
    df = spark.createDataFrame(rows, "field int, id bigint, seq string").repartition(3)
    got = {tuple(r) for r in nearcopies.similar_ids(df).collect()}
    want = set()
    held = [(f, i, s, {s[j : j + 11] for j in range(len(s) - 10)}) for f, i, s in rows if s is not None and i is not None and len(s) >= 11]
    for f, i, _, p in held:
        for g, j, _, q in held:
            if f == g and i < j and len(p & q) >= 0.5 * len(p | q):
                want.add((f, i, j))
    assert got == want
    cls = {(r["field"], r["id"]): r["class_id"] for r in nearcopies.classes(df).collect()}
    assert set(cls) == {(f, i) for f, i, *_ in held}
    assert all(cls[f, i] == cls[f, j] for f, i, j in want)


def test_a_shared_adapter_is_no_candidate(spark):
    """A third of all reads carry one adapter: it makes no candidates, true copies are still found."""
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    adapter = say(45)
    rows = [(0, i, adapter + say(60) if i % 3 == 0 else say(105)) for i in range(6000)]
    rows += [(0, 10_000 + i, rows[i][2][:70] + "A" + rows[i][2][71:]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "field int, id bigint, seq string")
    uniq = nearcopies.unique_sequences(df)
    cls, _, _ = nearcopies.token_table(uniq.select("field", "uid", "key"), 11)
    assert (cls[0] == 4).sum() >= 30
    assert nearcopies._candidates(uniq.select("field", "uid", "key"), 11, 0.5).count() < 2000
    got = {(r["id_low"], r["id_high"]) for r in nearcopies.similar_ids(df).collect()}
    assert {(i, 10_000 + i) for i in range(60)} <= got and len(got) < 70


def test_the_index_does_not_grow_with_records_times_buckets(spark, monkeypatch):
    """What every bucket gets of every block is small against the postings, and small blocks, buckets and counts lose no pair."""
    rng = random.Random(4)
    rows = [(i % 2, i, "".join(rng.choice("ACGT") for _ in range(rng.randint(60, 110)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "field int, id bigint, seq string").coalesce(1)
    held, whole = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: held.append(self) or whole(self, *a))
    monkeypatch.setattr(nearcopies, "PER_BUCKET", 1000)
    nearcopies._candidates(nearcopies.unique_sequences(df).select("field", "uid", "key"), 11, 0.5)
    n = held[0].agg(F.sum(F.length("blob")).alias("lists"), F.sum(F.length("runs") + F.length("sizes")).alias("rest")).first()
    assert n["rest"] < 0.5 * n["lists"]
    for name, value in (("PER_BUCKET", 100), ("ROWS", 16), ("PER_BLOCK", 500), ("PORTION", 200), ("MEETINGS", 3)):
        monkeypatch.setattr(nearcopies, name, value, raising=False)
    seqs = [s for s in _sequences(rng) if len(s) >= 11]
    got = {(r["id_low"], r["id_high"]) for r in nearcopies.similar_ids(spark.createDataFrame([(0, i, s) for i, s in enumerate(seqs)], "field int, id bigint, seq string")).collect()}
    cut = [{s[j : j + 11] for j in range(len(s) - 10)} for s in seqs]
    assert got == {(i, j) for j in range(len(seqs)) for i in range(j) if len(cut[i] & cut[j]) >= 0.5 * len(cut[i] | cut[j])}


def test_packing_is_reversible(spark):
    s = ["A", "AC", "ACG", "ACGTNRYKMSWBDHV", "AC-GT", "0", "00", "é", "", "acgt", "V" * 999]
    d = spark.createDataFrame([(x,) for x in s], "s string").select("s", nearcopies.unpack(nearcopies.pack(F.col("s"))).alias("t"), nearcopies.pack(F.col("s")).alias("k"))
    rows = d.collect()
    assert all(r["s"] == r["t"] for r in rows) and len({bytes(r["k"]) for r in rows}) == len(s)
    for some in (rows, [r for r in rows if r["k"] and r["k"][0]]):
        buf, offs = nearcopies.packed_buffer(pa.array([bytes(r["k"]) for r in some], pa.binary()))
        assert [buf[x:y].tobytes().decode() for x, y in zip(offs, offs[1:])] == [r["s"] for r in some]


def test_similarities_are_exact():
    rng = random.Random(6)
    half = {c: i + 1 for i, c in enumerate(nearcopies.LETTERS)}
    put = lambda s: bytes.fromhex(("0" if len(s) % 2 else "") + "".join(f"{half[c]:x}" for c in s)) if set(s) <= set(half) else b"\0" + s.encode()
    for letters in ("ACGT", "ACGTNRYKMSWBDHV", "ACGT0-"):
        a = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 60))) for _ in range(50)]
        b = [x[rng.randint(0, 3) :] + x[:9] if rng.random() < 0.7 else x[::-1] for x in a]
        got = nearcopies.similarities(pa.array([put(x) for x in a]), pa.array([put(x) for x in b]), 5)
        for x, y, s in zip(a, b, got):
            p, q = {x[j : j + 5] for j in range(len(x) - 4)}, {y[j : j + 5] for j in range(len(y) - 4)}
            assert s == len(p & q) / max(len(p | q), 1)


def test_near_copies_empty(spark):
    df = spark.createDataFrame([], "field int, id bigint, seq string")
    assert nearcopies.similar_ids(df).count() == 0


def test_block_max_wand_equals_exhaustive_search():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(12, 40)))) for i in range(80)]
    index = leakage.ItemIndex(items, n=1, block=4)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.keys)), rng.randint(1, 40)))
        score = np.zeros(len(index.ids))
        for t in terms:
            for d, s in zip(index.docs[t], index.scores[t]):
                score[d] += s
        assert sorted(index.retrieve(terms)) == np.flatnonzero(score >= 1 - 1e-9).tolist()


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, say(rng.randint(8, 50))) for i in range(40)]
    items.append((40, items[0][1]))
    docs = []
    for d in range(120):
        w = say(rng.randint(0, 200))
        if rng.random() < 0.5:
            src = rng.choice(items)[1]
            n = rng.randint(8, 20)
            at = rng.randint(0, max(0, len(src) - n))
            spot = rng.randint(0, len(w))
            w = w[:spot] + src[at : at + n] + w[spot:]
        docs.append((d, " -- ".join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (502, " ".join(say(30_000) + items[5][1]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, "")], "item_id bigint, item_text string")
    got = {tuple(r) for r in leakage.leaks(df, it).collect()}
    runs = {i: {tuple(w[a : a + 12]) for a in range(len(w) - 11)} for i, w in items}
    want = set()
    for d, t in docs:
        w = leakage.words(t)
        held = {tuple(w[a : a + 12]) for a in range(len(w) - 11)}
        want |= {(d, i) for i, r in runs.items() if r & held}
    assert got == want and want
    assert leakage.leaks(df.where("false"), it).count() == 0 and leakage.leaks(df, it.where("false")).count() == 0


def test_leaks_in_shards(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_ITEMS", 3)
    text = [" ".join(f"a{i}x{j}" for j in range(15)) for i in range(8)]
    it = spark.createDataFrame(list(enumerate(text)), "item_id bigint, item_text string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id bigint, text string")
    far = spark.createDataFrame([(100, " ".join(f"z{j}" for j in range(900)) + " " + text[2][20:] + " and " + text[6]), (101, None), (102, text[1][:40])], df.schema)
    got = leakage.leaks(df.unionByName(far), it)
    assert {tuple(r) for r in got.collect()} == {(i, i) for i in range(8)} | {(100, 6)}
    asked = it.withColumn("question", F.when(F.col("item_id") < 7, F.concat(F.lit("Which A"), F.col("item_id").cast("string"), F.lit("X1, a6x2?"))))
    over = {(r["doc_id"], r["item_id"]): (r["question_words"], r["question_shared"]) for r in leakage.question_overlap(got, df.unionByName(far), asked).collect()}
    assert over[0, 0] == (3, 1) and over[6, 6] == (3, 2) and over[7, 7] == (0, 0) and over[100, 6] == (3, 2)


def test_pareto_sample_is_fixed_size_and_unequal(spark):
    s = spark.range(4000).select(F.col("id").alias("_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("_source"), (F.col("id") % 50 + 1).alias("size"))
    s = s.withColumn("weight", F.when(F.col("_id") % 2 == 0, 3.0).otherwise(1.0))
    plan = spark.createDataFrame([("a", 9000), ("b", 30_000)], "_source string, rest bigint")
    got = mixing.pareto_sample(s, plan)
    again = mixing.pareto_sample(s.repartition(7), plan)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    size = {r["_source"]: r["n"] for r in got.groupBy("_source").agg(F.sum("size").alias("n")).collect()}
    assert abs(size["a"] - 9000) <= 50 and abs(size["b"] - 30_000) <= 50
    share = got.groupBy(F.col("_id") % 2).count().collect()
    n = {r[0]: r[1] for r in share}
    assert 2 < n[0] / n[1] < 4  # three times the odds


def test_mix_reaches_targets_within_caps(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "Big-One").when(F.col("id") < 590, " big_two").when(F.col("id") < 599, "tiny").otherwise("other").alias("source"), F.repeat(F.lit("some words here. "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1000, "tiny", None), (1001, None, "x"), (1002, "tiny", "")], "doc_id bigint, source string, text string"))
    t = spark.createDataFrame([("big_one", 0.3, 2), ("big two", 0.5, 2), ("tiny", 0.2, 3), ("gone", 0.0, 1)], "source_name string, target_share double, max_repeats int")
    rows, report = mixing.mix(docs, t, weight="sqrt(size)")
    r = {x["source_name"]: x for x in report.collect()}
    assert not r["tiny"]["reachable"] and r["tiny"]["used"] == 3 * r["tiny"]["available"]
    total = sum(x["available"] for x in r.values())
    for s in ("big_one", "big two"):
        assert r[s]["reachable"] and abs(r[s]["used"] - r[s]["target_share"] * total) <= 30
    assert r["gone"]["used"] == 0
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-9
    assert rows.groupBy("_id").agg(F.sum("copies").alias("c")).agg(F.max("c")).first()[0] <= 3


def test_endings(spark):
    whole = ["It ends.", "Does it?", "Yes!”", "(It ends.)", "x\n-- jo (night shift)", "a | b\n| c | 1 |", "t.\nKeywords: a, b", "t.\nFiles: a/b.tsv", "l\nexit status 1", "l\nfinished in 6.5 s", "t\n```\ncode\n```", "It ends.  \n ", "It ends.\t\r\n", "It. ends.\"\n"]
    cut = ["It en", "It ends...", "It ends…", "It ends… ", "bu�", "t\n```\ncode", "t\n```", "l\nfinished in 64.", "l\nexit status", "| a | 1", "see (it", "it is .\n.\n.", "so .. .\")"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*whole, *cut, None, "", "  "])], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", truncation.closes(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(got))] == [True] * len(whole) + [False] * len(cut) + [None] * 3


def test_length_spikes(spark):
    rng = random.Random(1)
    rows = [(i, "s1", ("word " * 60)[: rng.randint(40, 199)] + ".") for i in range(300)]
    rows += [(1000 + i, "S1 ", ("abcde " * 60)[:200].rstrip() + "x" * (200 - len(("abcde " * 60)[:200].rstrip()))) for i in range(40)]
    rows += [(2000 + i, "s2", ("é" * rng.randint(10, 90)) + ".") for i in range(100)] + [(3000, None, "cut he"), (3001, "s3", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = truncation.truncated(df)
    by = {r["cause"]: r["n"] for r in found.groupBy("cause").agg(F.count("*").alias("n")).collect()}
    assert by["field_limit"] == 40 and by["transfer"] == 1
    r = {x["source"]: x for x in truncation.rates(found).collect()}
    assert r["s1"]["limits_chars"] == "200" and r["s2"]["limits_chars"] == "" and r["s1"]["n_cut"] == 40
    stray = df.unionByName(spark.createDataFrame([(4000, "s1", "word " * 80 + ".")], df.schema))  # a longer value hides no limit
    assert {x["source"]: x["limits_chars"] for x in truncation.rates(truncation.truncated(stray)).collect()}["s1"] == "200"
    two = df.withColumn("note", F.when(F.col("doc_id") < 60, F.repeat(F.lit("n"), F.lit(50))).when(F.col("doc_id") < 300, F.concat(F.repeat(F.lit("n"), (F.col("doc_id") % 97 + 1).cast("int")), F.lit("."))))
    r = {(x["source"], x["field"]): x for x in truncation.rates(truncation.truncated(two, text=["text", "note"])).collect()}
    assert r["s1", "note"]["limits_chars"] == "50" and r["s1", "note"]["n_field_limit"] == 60 and r["s1", "text"]["limits_chars"] == "200"
    assert truncation.truncated(df.where("false")).count() == 0


CLASH = ["_id", "_x", "_uid", "uid", "peak", "density", "codes", "size", "weight", "copies", "rank", "chars", "closed", "cause", "a", "b", "low", "high", "n", "root", "field_name", "class_id", "n_links", "sketch", "n_values", "_source", "item_id", "bucket"]


def test_extra_columns_with_clashing_names(spark):
    extra = [F.lit(None).cast("string").alias(c) for c in CLASH]
    x = spark.createDataFrame([(1, [1, 2, 3, 1]), (2, [1, 2, 3, 1]), (None, [1, 2, 3, 1])], "k bigint, x array<int>").select("*", *extra)
    assert {tuple(r) for r in similarity.labels(similarity.density_peaks(x, "k", "x", 1)).collect()} == {(1, 1), (2, 1)}
    v = spark.createDataFrame([("g", 1), ("g", 3), (None, None)], "g string, v int").select("*", *extra)
    assert percentiles.sketch(v, ["g"], "v").first()["n_values"] == 2
    q = spark.createDataFrame([(0, 1, "ACGTTGCAACGGT"), (0, 2, "ACGTTGCAACGGT"), (0, 3, None)], "field int, id bigint, seq string").select("*", *extra)
    assert [tuple(r) for r in nearcopies.similar_ids(q).collect()] == [(0, 1, 2)]
    assert {(r["id"], r["class_id"]) for r in nearcopies.classes(q).collect()} == {(1, 1), (2, 1)}
    text = " ".join(f"w{i}" for i in range(14))
    d = spark.createDataFrame([(1, text, "s"), (2, None, None), (3, "", "s")], "doc_id bigint, text string, source string").select("*", *extra)
    it = spark.createDataFrame([(7, text)], "item_id bigint, item_text string").withColumn("doc_id", F.lit(1)).withColumn("text", F.lit("x"))
    assert [tuple(r) for r in leakage.leaks(d, it).collect()] == [(1, 7)]
    t = spark.createDataFrame([("s", 1.0, 1)], "source_name string, target_share double, max_repeats int").select("*", *extra)
    rows, report = mixing.mix(d, t)
    assert report.first()["actual_share"] == 1 and rows.count() >= 1
    assert truncation.truncated(d).where("cause is not null").count() == 1


def test_tokens_of_the_public_tokenizer(spark):
    d = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",), ("x" * 5000,)], "t string")
    n = [r[0] for r in d.select(mixing.token_count(F.col("t"))).collect()]
    assert n[0] == 2 and n[1:3] == [0, 0] and n[3] > 1 and n[4] > 100


def _peaks_by_hand(rows, radius, windows=5):
    """Labels by brute force: density by windows, nearest denser neighbour; order of equal densities by the operator's own hash."""
    sites = max(map(len, rows.values()))
    edges = np.linspace(0, sites, windows + 1).astype(int)
    density = dict.fromkeys(rows, 0)
    for i, x in rows.items():
        for lo, hi in zip(edges, edges[1:]):
            if None not in x[lo:hi]:
                density[i] += sum(y[lo:hi] == x[lo:hi] for j, y in rows.items() if j != i)
    return density


def _gap(x, y, radius):
    both = [(p, q) for p, q in zip(x, y) if p is not None and q is not None]
    return sum(p != q for p, q in both) if len(both) > radius else radius + 1


def _chains(rng, sites=40):
    """Clusters that are chains, not cliques: every step edits a few more sites."""
    rows = []
    for length in (30, 12, 3):
        x = [rng.randrange(4) for _ in range(sites)]
        for _ in range(length):
            x = list(x)
            for i in rng.sample(range(sites), 4):
                x[i] = rng.randrange(4)
            rows += [list(x)] * rng.randint(1, 3)
            y = list(x)
            for i in rng.sample(range(sites), rng.randint(0, 9)):
                y[i] = None
            rows.append(y)
    return rows


@pytest.mark.parametrize("chunk,cohort", [(5, 3)])
def test_peaks_of_chains_do_not_depend_on_the_layout(spark, monkeypatch, tmp_path, chunk, cohort):
    """Peaks are exactly the records without a denser neighbour; files, batches and parts change nothing."""
    rows = dict(enumerate(_chains(random.Random(9))))
    df = spark.createDataFrame(list(rows.items()), "k bigint, x array<int>")
    want = _peaks_by_hand(rows, 6)
    monkeypatch.setattr(similarity, "COHORT", cohort)
    seen = []
    sent = similarity.BROADCAST_BYTES
    for n, size in ((1, 8192), (3, chunk), (7, chunk)):
        monkeypatch.setattr(similarity, "CHUNK", size)
        monkeypatch.setattr(similarity, "BROADCAST_BYTES", sent if n == 1 else 0)
        path = str(tmp_path / f"{n}")
        df.orderBy(F.xxhash64("k", F.lit(n))).repartition(n).write.parquet(path)
        m = similarity.density_peaks(spark.read.parquet(path), "k", "x", 6)
        got = m.collect()
        assert {r["id"]: r["density"] for r in got} == want
        name = {r["uid"]: r["id"] for r in got}
        seen.append({r["id"]: name[r["root"]] for r in got})
    assert seen[0] == seen[1] == seen[2]
    root = seen[0]
    for i, x in rows.items():
        near = [j for j in rows if j != i and _gap(x, rows[j], 6) <= 6]
        if root[i] == i:
            assert all(want[j] <= want[i] for j in near)
        else:
            assert any(want[j] >= want[i] for j in near)  # so only peaks are their own roots
            assert any(root[j] == root[i] for j in near)
    linked = _components(len(rows), [(i, j) for i in rows for j in range(i) if _gap(rows[i], rows[j], 6) <= 6])
    assert all(linked[i] == linked[root[i]] for i in rows)


def test_records_with_many_unknown_sites_stand_apart(spark, monkeypatch):
    """Records whose unknown sites break the blocks are compared with all others, in parts."""
    monkeypatch.setattr(similarity, "APART", 3)
    rng = random.Random(3)
    centre = [[rng.randrange(1000) for _ in range(12)] for _ in range(2)]
    rows = [list(centre[i % 2]) for i in range(20)]
    for i, x in enumerate(rows):
        for k in rng.sample(range(12), i % 7):
            x[k] = None
    df = spark.createDataFrame(list(enumerate(rows)), "k bigint, x array<int>")
    got = {r["id"]: r["first_id"] for r in similarity.labels(similarity.density_peaks(df, "k", "x", 3)).collect()}
    assert got == {i: i % 2 for i in range(20)}


def _roots_by_hand(spark, df, rows, radius):
    """Roots by comparing every record with every other: the nearest denser neighbour, ties to the denser, then by the hash."""
    src = df.select("k", F.col("x").alias("_x"))
    s = similarity._sites(src, radius)
    keys = [k for k in sorted(rows)]
    packed = s.pack(pa.array([rows[k] for k in keys], pa.list_(pa.int32()))).to_pylist()
    packed = spark.createDataFrame(list(zip(keys, packed)), "k bigint, c binary")
    tie = {r["k"]: r["t"] for r in packed.select("k", F.xxhash64("k", "c").alias("t")).collect()}
    density = _peaks_by_hand(rows, radius)
    parent = {}
    for i, x in rows.items():
        mine = (-density[i], tie[i])
        seen = [(_gap(x, rows[j], radius), -density[j], tie[j], j) for j in rows if (-density[j], tie[j]) < mine]
        near = min((v for v in seen if v[0] <= radius), default=None)
        parent[i] = near[3] if near else i

    def root(i):
        return i if parent[i] == i else root(parent[i])

    return {i: root(i) for i in rows}


@pytest.mark.parametrize("kind,sent", [("few unknown", None), ("few unknown", 0), ("chains", None)])
def test_every_pointer_is_the_nearest_denser_record(spark, monkeypatch, kind, sent):
    """Where clusters are chains a record goes with its nearest denser neighbour, not with any within the radius."""
    monkeypatch.setattr(similarity, "COHORT", 2)
    monkeypatch.setattr(similarity, "CHUNK", 64)
    if sent is not None:
        monkeypatch.setattr(similarity, "BROADCAST_BYTES", sent)
    rng = random.Random(11)
    rows = [x for _ in range(3) for x in _chains(rng)]
    if kind == "few unknown":  # the third and later unknown sites of a record get other codes
        for x in rows:
            for i in [i for i, v in enumerate(x) if v is None][2:]:
                x[i] = rng.randrange(4)
    rows = dict(enumerate(rows))
    df = spark.createDataFrame(list(rows.items()), "k bigint, x array<int>")
    got = similarity.density_peaks(df, "k", "x", 6).collect()
    name = {r["uid"]: r["id"] for r in got}
    assert {r["id"]: name[r["root"]] for r in got} == _roots_by_hand(spark, df, rows, 6)


@pytest.mark.parametrize("clusters,size,edits,radius", [(1, 1500, 5, 10), (150, 10, 3, 8), (2, 600, 9, 6)])
def test_divided_buckets_miss_no_nearer_record(monkeypatch, clusters, size, edits, radius):
    """A bucket too large for all pairs is divided by lists or blocks; gaps up to ``near`` equal brute force, at fewer pairs."""
    monkeypatch.setattr(similarity, "COHORT", 4)
    rng = np.random.default_rng(clusters)
    x = np.repeat(rng.integers(0, 4, (clusters, 80)), size, axis=0)
    n, near = len(x), radius // 2
    hit = rng.random((n, 80)).argsort(1) < rng.integers(0, edits + 1, n)[:, None]
    x = np.where(hit, rng.integers(0, 4, (n, 80)), x)
    gone = rng.random((n, 80)).argsort(1) < rng.choice([0, 0, 0, 1, 3], n)[:, None]
    order = rng.permutation(n)
    order = order[np.argsort(hit.sum(1)[order], kind="stable")]  # as densities would
    x, gone = x[order], gone[order]
    s = similarity.Sites(80, 0, 3, radius, 3)
    raw = s.read(s.pack(pa.array([[None if g else int(v) for v, g in zip(*r)] for r in zip(x, gone)], pa.list_(pa.int32()))))
    pairs = [0]
    meet = similarity._Search.meet
    monkeypatch.setattr(similarity._Search, "meet", lambda self, i, j: (pairs.__setitem__(0, pairs[0] + len(i)), meet(self, i, j))[1])
    best = similarity._Search(s, near, np.zeros(n, np.int64), np.ones(n, bool), raw).best
    for i in range(1, n):
        d = ((x[i] != x[:i]) & ~gone[i] & ~gone[:i]).sum(1)
        j = int(d.argmin())
        if d[j] <= near:
            assert best[i] == d[j] * n + j
        else:
            assert best[i] // n > near
    assert edits > radius or pairs[0] < n * n / 4
