"""op1 and op4: held-out accuracy and hand-made cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loamline.llm import lm_scoring, toxicity

DOC = "doc_id long, text string, lang string, source string, word string, n long, mean double, target boolean"
LABEL = "doc_id long, quality int, toxic int, text string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", "w", 1, 0.5, True) for i, t in texts], DOC)


def test_scores_prefer_what_is_like_the_target(spark):
    rng = random.Random(1)
    text = lambda words: " ".join(rng.choice(words) for _ in range(60))
    good, other = ["sun", "moon", "star", "sky", "light"], ["buy", "now", "cheap", "pills", "light"]
    texts = [(i, text(good if i % 2 else other)) for i in range(200)] + [(900, None), (901, ""), (902, "Unseen"), (1, "moon star")]
    targets = spark.createDataFrame([(i,) for i in range(1, 100, 2)] + [(None,)], "doc_id long")
    found = lm_scoring.cross_entropy_difference(documents(spark, texts), targets, 64, 4096).collect()
    assert len(found) == len(texts)
    score = {r["doc_id"]: r["score"] for r in found}
    assert min(score[i] for i in range(101, 200, 2)) > max(score[i] for i in range(100, 200, 2))
    assert score[900] is None and score[901] is None and math.isfinite(score[902])
    assert [r["n_tokens"] for r in found if r["doc_id"] == 900] == [0]


def brute_losses(texts, targets):
    """Losses by the formula with all words and pairs, each text scored without its own counts."""
    split = [(t or "").lower().split() for _, t in texts]
    pairs = [Counter(zip([None, *w], w, strict=False)) for w in split]
    words = [Counter({**Counter(w), **({None: 1} if w else {})}) for w in split]
    total = sum(map(len, split))
    total_target = sum(len(w) for (i, _), w in zip(texts, split, strict=True) if i in targets)
    distinct = len({x for w in split for x in w})
    out = Counter()
    for k, (i, _) in enumerate(texts):
        means = []
        for target in (True, False):
            others = [j for j in range(len(texts)) if j != k and (not target or texts[j][0] in targets)]
            scale = 1 if target else total_target / total
            c1, c2 = sum((words[j] for j in others), Counter()), sum((pairs[j] for j in others), Counter())
            n = scale * sum(len(split[j]) for j in others)
            losses = []
            for v, w in zip([None, *split[k]], split[k], strict=False):
                top = scale * c2[v, w] + 4 * (scale * c1[w] + 1 / distinct) / (n + 1)
                losses.append(-math.log(top / max(scale * c1[v] + 4, top)))
            means.append(round(sum(losses) / len(losses), 9) if losses else None)
        out[i, len(split[k]), *means] += 1
    return out


def test_losses_use_exact_counts_of_all_words_and_pairs(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(rng.randint(0, 60)))) for i in range(50)]
    texts += [(90, None), (None, "w1 w2"), (1, "Once W2 once"), (1, "Once W2 once")]
    targets = set(range(0, 50, 3)) | {1}
    found = lm_scoring.cross_entropy_difference(documents(spark, texts), spark.createDataFrame([(i,) for i in targets], "doc_id long"), 500, 900).collect()
    rounded = lambda x: None if x is None else round(x, 9)
    assert Counter((r["doc_id"], r["n_tokens"], rounded(r["target_loss"]), rounded(r["background_loss"])) for r in found) == brute_losses(texts, targets)


def test_texts_in_another_order_raise_an_error(spark, tmp_path):
    """A source that gives its rows in another order each time: 40 texts of one size and one number of words and pairs."""
    import pytest

    flag = str(tmp_path / "read")
    kind = "doc_id long, text string"
    texts = [(i, f"w{i} x{i} y{i}") for i in range(10, 50)]

    def shuffled(batches):
        import os
        import random

        import pyarrow as pa

        with open(flag, "a") as log:
            log.write("x")
        rows = random.Random(os.path.getsize(flag)).sample(texts, len(texts))
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])

    docs = spark.range(1).coalesce(1).mapInArrow(shuffled, kind)
    with pytest.raises(Exception, match="another order"):
        lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(10,)], "doc_id long"), 30, 60).collect()


def test_ids_of_another_type(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two three"), (None, None)], "doc_id string, text string")
    found = lm_scoring.cross_entropy_difference(docs, docs.select("doc_id").limit(1), 16, 64)
    assert dict(found.dtypes)["doc_id"] == "string" and found.count() == 3


def test_without_targets_all_scores_are_zero(spark):
    docs = documents(spark, [(1, "a b c"), (2, "a a")])
    assert [r["score"] for r in lm_scoring.cross_entropy_difference(docs, docs.select("doc_id").limit(0), 16, 64).collect()] == [0.0, 0.0]
    assert lm_scoring.cross_entropy_difference(docs.limit(0), docs.select("doc_id"), 16, 64).isEmpty()


def test_model_probabilities_sum_to_one():
    words, bigrams = np.array([2.0, 5.0, 3.0]), np.zeros(9)
    for a, b in [(0, 1), (1, 2), (2, 1), (1, 1), (1, 0), (0, 2), (2, 0), (2, 1), (1, 2), (1, 1)]:
        bigrams[a * 3 + b] += 1
    model = lm_scoring.Model(words, bigrams)
    for before in range(3):
        p = [(model.bigrams[before * 3 + w] + lm_scoring.BIGRAM_PRIOR * model.word[w]) / (words[before] + lm_scoring.BIGRAM_PRIOR) for w in range(3)]
        assert abs(sum(p) - 1) < 1e-5


def toxic_corpus(n=900):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.randint(30, 120))], i % 4 == 0
        if bad:
            for _ in range(max(1, len(words) // 25)):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "Awful!"]))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(bad), "t"))
    return texts, labels


def test_held_out_toxic_texts_are_found_and_clean_ones_left(spark):
    texts, labels = toxic_corpus()
    extra = [(5000, None), (5001, ""), (5002, "unseen only"), (0, texts[0][1]), (None, "word1")]
    found = toxicity.score_toxicity(documents(spark, texts + extra), spark.createDataFrame([*labels, (None, 1, 1, "t"), (7, 1, None, "t")], LABEL)).collect()
    assert len(found) == len(texts) + len(extra)
    truth = {i: t for i, _, t, _ in labels}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert sum(right) / len(right) > 0.95


def test_held_out_labels_change_no_score(spark):
    texts, labels = toxic_corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t, x) for i, q, t, x in labels]
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(documents(spark, texts), spark.createDataFrame(x, LABEL)).collect()} for x in (labels, flipped))
    assert a == b


def test_the_join_gives_the_same_scores(spark):
    texts, labels = toxic_corpus(400)
    texts += [(7000, None), (None, ""), (7001, "long " * 300_000), (7002, "w" * 3000)]
    truth = {i: t for i, _, t, _ in labels}
    a, b = ({r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score_toxicity(documents(spark, texts), spark.createDataFrame(labels, LABEL), **k).collect()} for k in ({}, {"broadcast_nodes": 0}))
    held = [a[i][1] == truth[i] for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(held) / len(held) > 0.95
    assert a == b


def counts_of(spark, words):
    """A table as of ``_count``: words with (class, part) of each text that has them."""
    rows = [(w.encode(), *[at.count((c, k)) for c in range(2) for k in range(toxicity.PARTS)]) for w, at in words.items()]
    kinds = ", ".join(f"{c} long" for c in toxicity.COUNTS)
    counts = spark.createDataFrame(rows, f"word binary, {kinds}").mapInArrow(toxicity._nodes, f"node long, parent long, {kinds}")
    return counts.groupBy("node").agg(F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in toxicity.COUNTS])


def test_letters_counts_and_probabilities_equal_brute_force(spark):
    rng = random.Random(5)
    words = {w: [(rng.randrange(2), rng.randrange(4)) for _ in range(rng.randint(1, 30))] for w in ("a", "ab", "abc", "abd", "b", "é", "ax")}
    rows = toxicity.with_beginnings(counts_of(spark, words)).collect()
    steps = Counter()
    for w, at in words.items():
        raw = w.encode()
        for h, x in [*((raw[:k], raw[k : k + 1]) for k in range(len(raw))), (raw, b" ")]:
            for c, _ in at:
                steps[h, x, c] += 1
    beginnings = {h for h, _, _ in steps}
    assert len(rows) == len({(h, x) for h, x, _ in steps})
    d = [0.7, 0.4]
    by_parent = {}
    for r in rows:
        n, t = ([sum(r[f"{x}{c}_{k}"] for k in range(4)) for c in range(2)] for x in "nt")
        p = [float(toxicity.probability(np.float64(n[c]), np.float64(t[c]), np.float64(r[f"k{c}"]), np.float64(sum(n) / sum(t)), d[c])) for c in range(2)]
        by_parent.setdefault(r["parent"], []).append((*n, *t, *p))
    assert len(by_parent) == len(beginnings)
    for h in beginnings:
        found = by_parent[toxicity.path(h)[-2]]
        letters = {x for g, x, _ in steps if g == h}
        totals = [sum(steps[h, x, c] for x in letters) for c in range(2)]
        kinds = [sum(steps[h, x, c] > 0 for x in letters) for c in range(2)]
        wanted = []
        for x in letters:
            n = [steps[h, x, c] for c in range(2)]
            shared = sum(n) / sum(totals)
            p = [(max(n[c] - d[c], 0) + d[c] * kinds[c] * shared) / totals[c] if totals[c] else shared for c in range(2)]
            wanted.append((*n, *totals, *p))
        assert np.allclose(sorted(found), sorted(wanted))
        for c in range(2):
            assert abs(sum(r[4 + c] for r in found) - 1) < 1e-12


def test_one_discount_below_one_at_every_size(spark):
    for size in (1, 1000):
        counts = [(i, *([0] * 4), 1 + i % 2, 0, 0, 0) for i in range(30)] + [(100, *([9 * size] * 4), *([5 * size] * 4))]
        assert toxicity.discounts(spark.createDataFrame(counts, ["node", *toxicity.COUNTS])) == [0.5, 16 / (16 + 32)]


def test_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], LABEL)
    assert [r["score"] for r in toxicity.score_toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(docs.limit(0), none).isEmpty()
