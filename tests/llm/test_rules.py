"""op3, op5, op6, op9 and op10 on hand-made texts."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import decontaminate, licenses, mixing, quality, warc

DOC = "doc_id long, text string, lang string, source string, n_words long, uid long, words string, grp string, gram long"


def documents(spark, texts, source="s", lang="en"):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, "w", "g", 3) for i, t in texts], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


NINE = "one two three four five six seven eight nine"


def test_contamination(spark):
    bench = spark.createDataFrame([(10, NINE.upper() + ", TEN!", "x"), (2, NINE + " ten eleven", "x"), (3, "short É item", "x"), (4, None, "x"), (5, " .!", "x"), (None, "no id here", "x")], "item_id long, text string, words string")
    texts = [(1, f"Zero {NINE}-ten"), (2, NINE), (3, "a SHORT É-ITEM b"), (4, "short é item"), (5, None), (6, ""), (7, "no id here"), (8, f"{NINE} ten {NINE} ten eleven"), (8, "again"), (9, "x " * 3000 + "short É item")]
    found = decontaminate.contamination(documents(spark, texts), bench).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found)
    assert got == Counter([(1, 11, 10, ("10", "2")), (2, 9, 0, ()), (3, 5, 3, ("3",)), (4, 3, 0, ()), (5, 0, 0, ()), (6, 0, 0, ()), (7, 3, 3, ()), (8, 21, 21, ("10", "2")), (8, 1, 0, ()), (9, 3003, 3, ("3",))])
    shuffled = decontaminate.contamination(documents(spark, texts), bench, broadcast_windows=0).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in shuffled) == got


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, "bad words here")], "item_id long, text string")
    docs = documents(spark, [(1, "Some Bad words, here. End!"), (2, "fine\n"), (3, None), (None, "bad words here")])
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(by_id(kept)) == [2, 3]
    spans = by_id(decontaminate.decontaminate(docs, bench, mode="spans"))
    assert [spans[i]["text"] for i in (1, 2, 3, None)] == ["Some. End!", "fine\n", None, ""]
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contamination(docs.limit(0), bench).isEmpty()


def test_licenses(spark):
    texts = [
        (1, "Text. CC-BY, then cc by and All Rights\nReserved"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under the license, version 2.0"),
        (4, "the license of the work"), (5, None), (6, ""), (7, "accc by"), (8, "GNU General Public License"), (8, "x"), (9, "Released under " + "Pad " * 50 + "MIT license"),
    ]
    rows = licenses.license_scan(documents(spark, texts)).collect()
    found = {r["doc_id"]: r for r in rows if not (r["doc_id"] == 8 and r["n_words"] == 1)}
    assert len(rows) == len(texts)
    one = found[1]
    assert (one["n_words"], one["n_base"], one["first_word"], one["last_word"], one["base_labels"], one["score"]) == (10, 3, 1, 7, "cc-by,reserved", 1.0)
    assert [found[i]["labels"] for i in (2, 3, 4, 5, 6, 7, 8)] == ["apache-2.0", "apache-2.0", "", "", "", "", "gpl"]
    assert (found[2]["n_base"], found[2]["first_word"], found[2]["score"]) == (0, None, 1.0)
    assert 0.6 <= found[3]["score"] < 1 and found[4]["score"] == 0 and "mit" not in found[9]["labels"]
    assert licenses.license_scan(documents(spark, [])).isEmpty()


def test_targets_stop_at_twice_the_size(spark):
    rows = [("a", 10), ("b", 1000), (None, 500), ("c", 0), ("d", 2000)]
    found = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    total, weight, cap = 1.5 * 3510, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {s: 2 * n for s, n in rows}
    level = next(x for x in np.linspace(0, 5000, 2_000_001) if sum(min(cap[s], x * weight[s]) for s in cap) >= total)
    assert all(abs(found[s] - min(cap[s], level * weight[s])) < 0.1 for s in cap)
    assert abs(sum(found.values()) - total) < 1e-6


def test_pivot_keeps_words_and_means():
    rng = np.random.default_rng(3)
    size, share = rng.integers(1, 50, 200).astype(float), rng.random(200)
    taken = np.zeros(200)
    for _ in range(400):
        out, left = mixing.pivot(size, share, rng.random(200))
        whole = np.delete(out, left) if left >= 0 else out
        assert set(whole) <= {0.0, 1.0} and abs((out * size).sum() - (share * size).sum()) < 1e-6
        taken += out
    assert abs(taken / 400 - share).max() < 0.15


def test_equal_rows_are_spread_over_leaves(spark):
    equal = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"))
    others = spark.range(300).select(F.col("id").cast("int").alias("doc_id"), F.expr("IF(id % 3 = 0, 'b', 'a')").alias("source"), F.expr("repeat('w ', cast(id % 40 AS INT))").alias("text"))
    docs, size = equal.unionByName(others), mixing.count_space_words(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("row")).groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("times"))
    rates = mixing.source_targets(rows, times=F.col("times")).select(F.col("source").alias("t_source"), "source_size", "target", "n_docs", F.lit(1.5).alias("rate"))
    leaves = mixing.dealt(rows, rates, 64).groupBy("source", "node").count().collect()
    assert sum(r["count"] for r in leaves) == 5300 and max(r["count"] for r in leaves) < 128 and len(leaves) > 70
    runs = [sorted(map(tuple, mixing.mix(d, size, fan_in=64).collect()), key=str) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 5300
    made = mixing.mix(docs, size, fan_in=64).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"), F.sum("size").alias("all"), F.max("source_size").alias("source_size"))
    for r in made.collect():
        assert abs(r["taken"] - r["target"]) <= r["largest"] and r["all"] == r["source_size"]


def test_mix(spark):
    texts = [(i, "w " * (1 + i % 7)) for i in range(300)] + [(1000, None), (1001, ""), (1, "w " * 2), (1, "w " * 2)]
    docs = documents(spark, texts, "a").union(documents(spark, [(i, "v v v") for i in range(2000, 2050)], None)).union(documents(spark, [(i, "u " * 9) for i in range(3000, 3300)], "b"))
    size = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    runs = [mixing.mix(docs, size, fan_in=8).collect(), mixing.mix(docs.repartition(7), size, fan_in=8).collect()]
    keyed = [Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) for rows in runs]
    assert keyed[0] == keyed[1] and len(runs[0]) == docs.count()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in runs[0])
    for source in ("a", "b", None):
        rows = [r for r in runs[0] if r["source"] == source]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows)
    assert mixing.mix(docs.limit(0), size).isEmpty()
    mixed = mixing.mix_documents(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns and mixed.where("copies < 1").isEmpty()


def brute_statistics(text):
    text = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            covered |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_equal_brute_force(spark):
    texts = [(1, "a b c d e " * 3), (2, "x\ny\n \nx\nx \n"), (3, None), (4, ""), (5, "é# |\x0b<>%" + " w" * 30), (6, "a b c d e f a b c d e"), (7, " ".join(str(i % 50) for i in range(5000))), (8, "p q r s t\x1cu p q r s t\x1cu v")]
    found = by_id(quality.text_statistics(documents(spark, texts)))
    for i, text in texts:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_statistics(text), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_outliers_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(4)
    clean = [(i, " ".join("abcdefgh"[: rng.integers(2, 8)] + str(rng.integers(1000)) for _ in range(40))) for i in range(300)]
    junk = [(1000 + i, " ".join("#$%|" * 6 + str(rng.integers(1000)) for _ in range(40))) for i in range(40)]
    docs = documents(spark, clean + junk).union(documents(spark, [(5000, "## ## " + " ".join(map(str, range(40))))], "tiny", None))
    found = by_id(quality.quality_verdicts(docs))
    assert all(found[i]["kept"] for i, _ in clean) and not any(found[i]["kept"] for i, _ in junk)
    assert found[5000]["kept"]  # a group of one judges nobody
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and kept.count() == 301
    assert quality.quality_verdicts(docs.limit(0)).isEmpty()
    assert not by_id(quality.quality_verdicts(documents(spark, [(1, None), (1, None)])))[1]["kept"]


def brute_distances(x):
    """Minimum covariance determinant by concentration steps from two starts, with matrices."""
    x = x / quality.UNIT
    floors = np.diag([f**2 for f in quality.STATISTICS.values()])

    def shape(rows):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) + floors

    def distances(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    low, high = (np.sort(x, axis=0)[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.75))
    found = []
    for rows in (x, x[np.all((x >= low) & (x <= high), axis=1)]):
        m, c = shape(rows)
        for _ in range(quality.STEPS):
            step = np.floor(np.log(distances(m, c) + 1e-6) * 64)
            cut = np.sort(step)[int(np.ceil(quality.SHARE * len(x))) - 1]
            m, c = shape(x[step <= cut])
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    return distances(m, c) / quality.CONSISTENCY


def test_distances_equal_a_brute_force_determinant(spark):
    rng = np.random.default_rng(6)
    word = lambda: "abcdefgh"[: rng.integers(1, 8)] + "#" * int(rng.integers(0, 8) == 0) + str(rng.integers(2000))
    texts = [(i, ("\n" if i % 3 else " ").join([word() for _ in range(60)] + ["again"] * (i % 5))) for i in range(240)]
    docs = documents(spark, texts)
    rows = quality.text_statistics(docs).where("not base_failed").select("doc_id", quality._vector().alias("x")).collect()
    wanted = dict(zip([r["doc_id"] for r in rows], brute_distances(np.array([r["x"] for r in rows], float)), strict=True))
    found = by_id(quality.quality_verdicts(docs))
    assert len(wanted) > 100
    for i, d in wanted.items():
        assert abs(found[i]["distance"] - d) < 0.01 + 1e-3 * d
        assert found[i]["kept"] == (d <= quality.CUTOFF)


def brute_shrunk(groups):
    """The same for the sources of one language: in every step a source's moments and ``PRIOR_ROWS`` rows of the language's."""
    floors = np.diag([f**2 for f in quality.STATISTICS.values()])
    groups = {k: x / quality.UNIT for k, x in groups.items()}
    whole = np.concatenate(list(groups.values()))
    second = lambda rows: np.einsum("ij,ik->jk", rows, rows)

    def shape(rows, of=None):
        n, s, p = len(rows), rows.sum(axis=0), second(rows)
        if of is not None and len(of):
            n, s, p = n + quality.PRIOR_ROWS, s + of.mean(axis=0) * quality.PRIOR_ROWS, p + second(of) / len(of) * quality.PRIOR_ROWS
        m = s / n
        return m, p / n - np.outer(m, m) + floors

    def distances(x, m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def nearest(x, m, c):
        step = np.floor(np.log(distances(x, m, c) + 1e-6) * 64)
        return x[step <= np.sort(step)[int(np.ceil(quality.SHARE * len(x) - 1e-9)) - 1]]

    def box(x):
        low, high = (np.sort(x, axis=0)[int(np.ceil(q * len(x))) - 1] for q in (0.25, 0.75))
        return x[np.all((x >= low) & (x <= high), axis=1)]

    out = {k: [] for k in groups}
    for start in (lambda x: x, box):
        every = start(whole)
        own = {k: start(x) for k, x in groups.items()}
        own = {k: x for k, x in own.items() if len(x)}
        if not len(every):
            continue
        for _ in range(quality.STEPS):
            own = {k: nearest(groups[k], *shape(x, every)) for k, x in own.items()}
            every = nearest(whole, *shape(every))
        for k, x in own.items():
            m, c = shape(x, every)
            out[k].append((np.linalg.slogdet(c)[1], distances(groups[k], m, c) / quality.CONSISTENCY))
    return {k: min(found, key=lambda f: f[0])[1] for k, found in out.items()}


def test_sources_of_every_size_are_judged_by_one_rule(spark):
    rng = np.random.default_rng(8)
    word = lambda: "abcdefgh"[: rng.integers(1, 8)] + "#" * int(rng.integers(0, 8) == 0) + str(rng.integers(2000))
    docs, at = None, 0
    for source, n in (("one", 1), ("three", 3), ("below", 49), ("at", 50), ("many", 120)):
        texts = [(at + i, ("\n" if i % 3 else " ").join([word() for _ in range(60)] + ["again"] * (i % 5))) for i in range(n)]
        at += n
        rows = documents(spark, texts, source)
        docs = rows if docs is None else docs.unionByName(rows)
    vectors = quality.text_statistics(docs).where("not base_failed").select("doc_id", "source", quality._vector().alias("x")).collect()
    groups = {s: [r for r in vectors if r["source"] == s] for s in {r["source"] for r in vectors}}
    wanted = brute_shrunk({s: np.array([r["x"] for r in rows], float) for s, rows in groups.items()})
    found = by_id(quality.quality_verdicts(docs))
    assert len(groups) == 5
    for s, rows in groups.items():
        for r, d in zip(rows, wanted[s], strict=True):
            assert abs(found[r["doc_id"]]["distance"] - d) < 0.01 + 1e-3 * d, (s, r["doc_id"])


def test_rows_without_an_id_go_by_themselves(spark):
    clean = [(None, " ".join(f"w{i * 7 % 1000}x{j}" for j in range(40))) for i in range(80)]
    docs = documents(spark, [*clean, (None, "too short"), (None, None), (7, "too short"), (7, clean[0][1])])
    assert Counter(r["doc_id"] for r in quality.keep_quality(docs).collect()) == {None: 80, 7: 1}
    bench = spark.createDataFrame([(1, "too short")], "item_id long, text string")
    for clashing in (docs, docs.withColumn("d0", F.lit(1)).withColumn("row", F.lit(2)).withColumn("h_id", F.lit(3))):
        kept = decontaminate.decontaminate(clashing, bench)
        assert kept.columns == clashing.columns and Counter(r["doc_id"] for r in kept.collect()) == {None: 81, 7: 1}
        spans = decontaminate.decontaminate(clashing, bench, mode="spans")
        assert spans.columns == clashing.columns and Counter(r["text"] for r in spans.collect())[""] == 2


def record(spark, rows):
    kind = "record_id long, url string, ts long, status int, headers array<struct<name:string,value:string>>, payload string, key string, ref_id long"
    return spark.createDataFrame([(*r, "k", 5) for r in rows], kind)


def test_revisits(spark):
    tag = lambda t: [("ETag", t)]
    rows = [
        (1, "http://WWW.A.com:80/x/?b=1&utm_source=q&a=2#f", 10, 200, [("ETag", '"1"'), ("Content-Type", "text/html"), ("X", "old"), ("X", "old2")], "one"),
        (2, "https://a.com/x?a=2&b=1", 20, 304, [("etag", 'W/"1"'), ("x", "new"), ("Content-Type", "bad"), ("Hop", "h"), ("Connection", "hop")], None),
        (3, "a.com/x?a=2&b=1", 30, 200, tag('"2"'), "two"),
        (4, "http://a.com/x?b=1&a=2", 40, 304, tag('"1"'), None), (5, "http://a.com/x?b=1&a=2", 10, 304, tag('"1"'), None),
        (6, "http://a.com/y", 40, 304, tag('"1"'), None), (7, None, 50, 304, tag('"2"'), None), (8, "http://a.com/x?b=1&a=2", None, 304, tag('"2"'), None),
        (9, "http://a.com/x?b=1&a=2", 45, 304, None, None), (10, "http://a.com/x?b=1&a=2", 41, 404, None, "gone"),
        (11, "http://b.com/", 1, 200, [("Last-Modified", "d")], "b"), (12, "http://b.com", 2, 304, [("last-modified", "d")], None),
    ]
    found = {r["record_id"]: r for r in warc.resolve_revisits(record(spark, rows)).collect()}
    assert {i: (r["ref_id"], r["outcome"], r["status"], r["payload"]) for i, r in found.items()} == {
        2: (1, "resolved", 200, "one"), 4: (3, "validator mismatch", 304, None), 5: (None, "no earlier response", 304, None), 6: (None, "no earlier response", 304, None),
        7: (None, "no earlier response", 304, None), 8: (None, "no earlier response", 304, None), 9: (3, "no validator", 304, None), 12: (11, "resolved", 200, "b"),
    }
    assert [tuple(h) for h in found[2]["headers"]] == [("content-type", "text/html"), ("etag", 'W/"1"'), ("x", "new")]
    assert warc.resolve_revisits(record(spark, [])).isEmpty()


def test_hot_url_over_many_blocks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(4000).select(
            F.col("id").alias("record_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("id") % 50).cast("string"))).alias("key"),
            (F.hash("id") % 700).cast("long").alias("ts"), (F.col("id") % 40 == 1).alias("full"),
        )
        found = {r["record_id"]: r["ref_id"] for r in warc.latest_earlier(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    full = [r for r in rows.collect() if r["full"]]
    for r in rows.where("not full").collect():
        earlier = [(f["ts"], f["record_id"]) for f in full if f["key"] == r["key"] and f["ts"] < r["ts"]]
        assert found[r["record_id"]] == max(earlier, default=(0, None))[1]


@pytest.mark.parametrize(("url", "wanted"), [("HTTPS://User@www.X.org:443/A/b/#q", "x.org/A/b"), ("http://x.org?b&a=1&ref=2", "x.org?a=1&b"), ("x.org/", "x.org"), ("", ""), (None, None)])
def test_canonical_url(spark, url, wanted):
    assert spark.range(1).select(warc.canonical_url(F.lit(url).cast("string"))).first()[0] == wanted
