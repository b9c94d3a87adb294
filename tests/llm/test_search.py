"""op13: every rank and score against a brute-force search."""

import math
import random
import re
from collections import Counter

import numpy as np

from loamline.llm import lexical_search as ls

DOC = "doc_id {0}, text string, score long, n long, item_id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def documents(spark, rows, kind="long"):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOC.format(kind))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, queries, top):
    counted = [(i, Counter(WORD.findall(lower(t)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item, text in queries:
        asked = set(WORD.findall(lower(text)))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counted) + 1))) for t in asked}
        found = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def cases(seed=0):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}" + rng.choice(["", "", "é", "ß"])
    docs = [(rng.randint(-50, 400), " ".join(word() for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    docs += [(7, "Same, SAME text!")] * 40 + [(None, "same null"), (900, None), (901, ""), (902, "?! --"), (903, "w1 " * 3000)]
    queries = [(k, " ".join(word() for _ in range(rng.randint(1, 12)))) for k in range(25)]
    return docs, queries + [(50, "same"), (51, None), (52, ""), (53, "nowhere"), (54, "W1 w1 w2"), (54, "text"), (None, "w3")]


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_results_equal_brute_force_whatever_the_windows_and_rounds(spark):
    docs, queries = cases()
    asked = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id long, text string, doc_id int")
    wanted = brute(docs, queries, 10)
    table = documents(spark, docs).repartition(5)
    assert found(ls.search(table, asked)) == wanted
    assert found(ls.search(table, asked, window=16)) == wanted
    assert found(ls.search(table, asked, window=16, most_terms=9, task_bytes=500)) == wanted
    assert found(ls.search(table, asked, top=3)) == brute(docs, queries, 3)


def test_ids_of_another_type(spark):
    docs = [(f"d{i:03d}", "a b" if i % 2 else "b c c") for i in range(40)]
    asked = spark.createDataFrame([("q", "a c")], "item_id string, text string")
    got = ls.search(documents(spark, docs, "string"), asked, window=8).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [f"d{i:03d}" for i in range(0, 20, 2)]


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = documents(spark, [(1, "a")])
    assert ls.search(docs.limit(0), asked).isEmpty()
    assert ls.search(documents(spark, [(1, None)]), asked).isEmpty()
    none = ls.search(docs, asked.limit(0))
    assert none.isEmpty() and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_windows_take_every_row_once():
    import pyarrow as pa

    rng = random.Random(3)
    ids = sorted(rng.choice([rng.randint(-100, 100), 5]) for _ in range(500))
    lists = [list(range(k % 4)) for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([1] * 500), pa.array(lists, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "n", "terms", "tf"])
    seen = []
    for ids_of, n, term, place, tf in ls._windows(iter([batch.slice(0, 123), batch.slice(123, 200), batch.slice(323)]), 8):
        assert len(ids_of) == len(n) <= 8 and len({i // 8 for i in ids_of}) == 1
        assert np.array_equal(term, tf)
        seen += [(i, sorted(term[place == k].tolist())) for k, i in enumerate(ids_of)]
    assert seen == list(zip(ids, lists, strict=True))


def test_long_lengths_use_integers_of_any_size():
    n = np.array([10**14, 7])
    assert ls.lengths(n, 10**6, 10**15).tolist() == [10 + 90 * x * 10**6 // 10**15 for x in n.tolist()]
