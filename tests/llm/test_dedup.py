"""op2, op7 and op8 against brute force, on hand-made and generated texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamline.llm import components as cc
from loamline.llm import jaccard_join, repeats, suffix_array, suffix_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, key string, tid long, comp int"
SPACES = r"[^\x20\x09-\x0D]+"


def documents(spark, texts):
    """With further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "k", 2, 3) for i, t in texts], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(120))
    texts = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        kind = i % 6
        if kind == 1:
            text = f"{text}\n{passage}  {' '.join(word() for _ in range(5))}"
        elif kind == 2:
            w = passage.split()
            w[rng.randrange(len(w))] = word()
            text = " ".join(w)
        elif kind == 3 and texts:
            text = rng.choice(texts)[1] or ""
        elif kind == 4:
            text = f"{passage} {text} {passage}"
        texts.append((i * 3 % 61, text))
    return texts + [(900, None), (901, ""), (902, " \t\n"), (903, "one Two"), (904, "one two"), (905, passage * 40), (None, passage), (None, passage), (906, passage), (906, passage)]


def shingle_set(text, k):
    w = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, percent):
    sets = [shingle_set(t, k) for _, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(sets)):
        classes[find(i)].append(texts[i][0])
    least = {c: min((d for d in ids if d is not None), default=None) for c, ids in classes.items()}
    return Counter((texts[i][0], len(s), least[find(i)]) for i, s in enumerate(sets))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_jaccard_components_equal_brute_force(spark, seed, k, percent):
    texts = corpus(seed)
    found = jaccard_join.jaccard_components(documents(spark, texts), k, percent)
    assert Counter(map(tuple, found.collect())) == brute_components(texts, k, percent)


def test_groups_beyond_a_task_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 4000)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    texts = corpus(5)
    found = jaccard_join.jaccard_components(documents(spark, texts), 4, 85)
    assert Counter(map(tuple, found.collect())) == brute_components(texts, 4, 85)


NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def test_groups_left_over_are_narrowed_to_what_may_be_linked(spark):
    rng = np.random.default_rng(2)
    new = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    family, pair, common = new(60), new(60), new(3)
    sets = [np.unique(np.concatenate([family, new(1)])) for _ in range(40)]  # one class already
    sets += [np.unique(np.concatenate([pair[:57], new(3)])) for _ in range(2)]  # alike, not yet linked
    sets += [np.unique(np.concatenate([common, new(60)])) for _ in range(40)]  # little in common
    rows = [(7, 9, 0, i, 0 if i < 40 else i, x.tobytes()) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "comp long, parts int, part int, sid long, class long, tokens binary")
    left = jaccard_join.narrowed(table, 85, spark.sparkContext.broadcast(NOTHING)).collect()
    assert {40, 41} <= {r["sid"] for r in left} and not any(r["sid"] < 40 for r in left)
    assert len({r["comp"] for r in left if r["sid"] in (40, 41)}) == 1 and {(r["parts"], r["part"]) for r in left} == {(1, 0)}
    assert jaccard_join.narrowed(table.limit(0), 85, spark.sparkContext.broadcast(NOTHING)).isEmpty()


@pytest.mark.parametrize(("seed", "k", "percent", "part"), [(1, 1, 50, 300), (2, 4, 85, 600)])
def test_groups_far_beyond_a_part_are_compared_by_lists(spark, monkeypatch, seed, k, percent, part):
    monkeypatch.setattr(jaccard_join, "PART_BYTES", part)
    texts = corpus(seed)
    found = jaccard_join.jaccard_components(documents(spark, texts), k, percent)
    assert Counter(map(tuple, found.collect())) == brute_components(texts, k, percent)


def test_a_large_group_of_little_in_common_stays_linear(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 1 << 18)
    rng = np.random.default_rng(4)
    n, common = 20_000, rng.integers(0, 1 << 63, 8).astype(np.uint64)
    own = rng.integers(0, 1 << 63, (n, 16)).astype(np.uint64)
    own[1::1000, :15] = own[::1000, :15]  # a pair in each thousand: 23 of 25 shingles
    sets = np.sort(np.concatenate([np.broadcast_to(common, (n, 8)), own], axis=1), axis=1)
    rows = [(7, 19, i % 19, i, i, x.tobytes()) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "comp long, parts int, part int, sid long, class long, tokens binary")
    nothing = spark.sparkContext.broadcast(NOTHING)
    left, local = jaccard_join.narrowed_again(table, 85, nothing, str(tmp_path / "rounds"))
    assert left.count() == 40 and {x for r in left.collect() for x in [r["sid"] % 1000]} == {0, 1}
    groups = jaccard_join.verification_groups(table, 85, local).groupBy("comp", "i", "j").count().collect()
    assert sum(g["count"] for g in groups) <= 40  # of all sets at once too, by the order that it came to
    found = jaccard_join.verified_classes(table.where("sid < 3000").drop("class"), 85, nothing)
    pairs = found.groupBy("root").agg(F.array_sort(F.collect_list("node")).alias("nodes")).collect()
    assert sorted(tuple(r["nodes"]) for r in pairs) == [(i, i + 1) for i in range(0, 3000, 1000)]


def test_lists_beyond_a_part_are_cut_by_further_orders(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 2000)
    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 10).astype(np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.concatenate([x[:-1], rng.integers(0, 1 << 63, 1).astype(np.uint64)])) for x in sets[:20]]
    rows = [(7, 9, i % 9, i, i, x.tobytes()) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "comp long, parts int, part int, sid long, class long, tokens binary")
    groups = jaccard_join.verification_groups(table, 80, spark.sparkContext.broadcast(NOTHING))
    together = {(x, y) for r in groups.groupBy("comp", "i", "j").agg(F.collect_list("sid").alias("s")).collect() for x in r["s"] for y in r["s"]}
    alike = [(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    within = {(i, j) for i, j in together if i % 9 == j % 9}  # parts by themselves are verified before
    assert alike and all(p in together or p in within for p in alike)


@pytest.mark.parametrize(("seed", "percent"), [(1, 40), (2, 60), (3, 85)])
def test_links_connect_what_similar_pairs_connect(seed, percent):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 1 << 63, 40).astype(np.uint64) for _ in range(6)]
    sets = []
    for i in range(60):
        own = base[i % 6].copy()
        own[rng.integers(0, 40, i % 20)] = rng.integers(0, 1 << 63, i % 20).astype(np.uint64)
        sets.append(np.unique(own))
    frequent, n = np.unique(np.concatenate(sets), return_counts=True)
    known = (frequent[n > 3], n[n > 3].astype(np.uint64))
    classes = [0 if i in (5, 11) else i + 1 for i in range(60)]
    alike = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]
    a, b = jaccard_join.similar_links(list(range(60)), sets, classes, percent, known)
    assert all((max(x, y), min(x, y)) in alike for x, y in zip(a, b, strict=True))
    label = lambda pairs: cc.roots(*(np.array(x, int) for x in zip(*[*pairs, (5, 11)], strict=True)), 60).tolist()
    assert label(list(zip(a, b, strict=True))) == label(alike)


def test_a_family_of_near_copies_costs_few_verifications(monkeypatch):
    rng = np.random.default_rng(1)
    base, sets = np.sort(rng.integers(0, 1 << 63, 60).astype(np.uint64)), []
    for _ in range(3000):
        own = base.copy()
        own[rng.integers(0, 60)] = rng.integers(0, 1 << 63)
        sets.append(np.unique(own))
    calls = []
    exact = np.intersect1d
    monkeypatch.setattr(np, "intersect1d", lambda *x, **k: calls.append(1) or exact(*x, **k))
    a, _ = jaccard_join.similar_links(list(range(3000)), sets, list(range(3000)), 85, NOTHING)
    assert len(a) == 2999 and len(calls) < 2 * 3000


def test_sets_that_share_passages_only_are_no_group(spark, monkeypatch):
    """A chain of texts that each share half with the next, with few shingles known: only the copies are candidates."""
    rng, candidates = random.Random(9), []
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(81)]
    texts = [(i, f"{a} {b}") for i, (a, b) in enumerate(zip(passages[:-1], passages[1:], strict=True))] + [(100, f"{passages[0]} {passages[1]} end")]
    count, verify = jaccard_join.frequent_shingles, jaccard_join.verified_classes
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda counted, *more, **own: count(counted, *(more or [0]), **own))
    monkeypatch.setattr(jaccard_join, "verified_classes", lambda tokens, *more: candidates.append(tokens.count()) or verify(tokens, *more))
    found = jaccard_join.jaccard_components(documents(spark, texts), 4, 85)
    assert Counter(map(tuple, found.collect())) == brute_components(texts, 4, 85)
    assert candidates == [2]


@pytest.mark.parametrize("comparisons", [20_000_000, 100])
def test_lists_connect_what_sketches_can_not_part(monkeypatch, comparisons):
    monkeypatch.setattr(jaccard_join, "COMPARISONS", comparisons)
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(20)]
    sets = [np.unique(np.concatenate([base[i % 20][i % 7 :], rng.integers(0, 1 << 63, i % 5).astype(np.uint64)])) for i in range(100)]
    size, sketch = np.array([len(x) for x in sets]), np.frombuffer(b"".join(jaccard_join.sketches(sets)), np.uint64).reshape(100, -1)
    alike = [(i, j) for i in range(100) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    for token in (np.zeros(100, int), np.arange(100) % 20):  # one long list; 20 short ones
        u, v = jaccard_join.linked_lists(token, np.arange(100), size, sketch, 85)
        label = cc.roots(np.append(u, 0), np.append(v, 0), 100)
        assert alike and all(label[i] == label[j] for i, j in alike)
        assert comparisons == 100 or len(set(label[:20].tolist())) == 20


def test_filters_never_know_a_shingle_as_too_rare(spark):
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    times = rng.integers(1, 12, 2000)
    counted = spark.createDataFrame([(int(t),) for t, n in zip(tokens, times, strict=True) for _ in range(n)], "token long")
    known = jaccard_join.frequent_shingles(counted, 300).value
    kinds = np.floor(2 * np.log2(times)).astype(np.uint64)
    assert len(known[0]) <= 300 and known[3] is not None
    classes = jaccard_join._order_keys(tokens, 0, known) >> np.uint64(58)
    least = np.array([max((c for c in jaccard_join.CLASSES if c <= k), default=0) for k in kinds.tolist()])
    assert (classes >= least).all() and (classes[times == 1] == 0).mean() > 0.8


def test_only_the_most_frequent_shingles_are_known(spark):
    counted = spark.createDataFrame([(t,) for t in [1] * 9 + [2] * 9 + [3] * 4 + [4]], "token long")
    for most, wanted in ((10, [1, 2, 3]), (2, [1, 2]), (1, [])):
        assert jaccard_join.frequent_shingles(counted, most).value[0].tolist() == wanted


def test_documents_of_a_large_class_are_not_dealt_by_it(spark, monkeypatch):
    texts = [(i, "the same few words in all of them") for i in range(5, 305)] + [(None, "lone words of no id at all"), (1, ""), (2, None), (3, "words that stand here alone, twice"), (4, "x")]
    plans, own = [], jaccard_join.checkpoint
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df)
    monkeypatch.setattr(jaccard_join, "checkpoint", noted)
    for most in (600_000, -1):  # few classes, and as many as are not broadcast: then documents and classes meet as they are, which Spark can split
        monkeypatch.setattr(jaccard_join, "limited", lambda rows, most=most: F.broadcast(rows) if rows.count() <= most else rows.hint("merge"))
        plans.clear()
        found = jaccard_join.jaccard_components(documents(spark, texts))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()} == {(i, 5, 5) for i in range(5, 305)} | {(None, 4, None), (1, 0, 1), (2, 0, 2), (3, 3, 3), (4, 1, 4)}
        assert {r["doc_id"] for r in jaccard_join.keep_one(documents(spark, texts)).collect()} == {None, 1, 2, 3, 4, 5}
        joins = [p for p in plans if re.search(r"Join \[class#", p)]
        assert len(joins) == 2
        for p in joins:
            assert "Aggregate(keys=[class#" not in p and (most < 0 or "hashpartitioning(class#" not in p)


def test_keep_one_leaves_one_row_of_a_class_and_all_columns(spark):
    texts = [(2, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (3, "x y"), (4, None), (5, ""), (None, "x y"), (None, "q r"), (None, "q r"), (None, None)]
    docs = documents(spark, texts)
    kept = jaccard_join.keep_one(docs)
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert found == sorted([(1, "a b c d e f"), (1, "other words here"), (3, "x y"), (4, None), (5, ""), (None, "q r"), (None, None)], key=str)
    assert kept.columns == docs.columns
    clashing = docs.withColumn("best", F.lit(1)).withColumn("row", F.lit(2)).withColumn("m_id", F.lit(3))
    assert jaccard_join.keep_one(clashing).count() == len(found)
    assert jaccard_join.jaccard_components(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).where("component_id = 'd1'").count() == 4


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components_of_paths_stars_and_loops(spark, one_task):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (500, 501), (501, 500)]
    found = cc.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()
    classes = defaultdict(set)
    for r in found:
        classes[r["root"]].add(r["node"])
    assert sorted(map(len, classes.values())) == [2, 31, 40]
    assert cc.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def brute_bytes(texts, length, first):
    raw = [(t or "").encode() for _, t in texts]
    order = sorted(range(len(raw)), key=lambda i: (texts[i][0] is None, texts[i][0] or 0))
    where = defaultdict(list)
    for rank, i in enumerate(order):
        for s in range(len(raw[i]) - length + 1):
            where[raw[i][s : s + length]].append((texts[i][0] if first else rank, s))
    out = Counter()
    for rank, i in enumerate(order):
        covered = np.zeros(len(raw[i]), bool)
        for s in range(len(raw[i]) - length + 1):
            places = where[raw[i][s : s + length]]
            own = (texts[i][0] if first else rank, s)
            key = lambda p: (p[0] is None, p[0] or 0, p[1])
            if (min(places, key=key) != own and key(min(places, key=key)) < key(own)) if first else len(places) > 1:
                covered[s : s + length] = True
        runs = int(np.sum(np.diff(np.concatenate([[0], covered.astype(int)])) == 1))
        out[(texts[i][0], len(raw[i]), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(raw[i], np.uint8)[~covered].tobytes()).hexdigest())] += 1
    return out


def digest(found):
    return Counter((r["doc_id"], r["n_bytes"], sum(c["end"] - c["begin"] for c in r["cuts"]), len(r["cuts"]), r["kept_sha256"]) for r in found.collect())


@pytest.mark.parametrize(("length", "anchor"), [(400, 32), (60, 8)])
def test_repeated_bytes_equal_brute_force(spark, length, anchor):
    texts = corpus(7)
    assert digest(suffix_array.remove_repeats(documents(spark, texts), length, anchor)) == brute_bytes(texts, length, False)


def test_first_copies_stay(spark):
    texts = [x for x in corpus(8) if x[0] is not None]
    texts = list({d: (d, t) for d, t in texts}.values())
    assert digest(suffix_array.remove_repeats(documents(spark, texts), 100, 8, keep_first=True)) == brute_bytes(texts, 100, True)


def test_cut_documents_keep_columns_and_lose_empty_ones(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(200))
    docs = documents(spark, [(1, text), (2, text), (3, "tail é " + text), (4, "clean"), (5, None)])
    kept = suffix_array.cut_later_copies(docs)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert found == {1: (text, 0), 3: ("tail é ", 7), 4: ("clean", 0), 5: (None, 0)}


def test_cuts_take_whole_characters(spark):
    shared = "".join(chr(0x4E00 + i * 37 % 3000) for i in range(200))
    docs = documents(spark, [(1, "á" + shared + "ж"), (2, "à" + shared + "з"), (3, "own " + shared + "ю")])
    found = {r["doc_id"]: r["text"] for r in suffix_array.cut_later_copies(docs, 60).collect()}  # á, à and ж, з share bytes
    assert found[1] == "á" + shared + "ж" and "\ufffd" not in found[2] + found[3]
    assert found[3] in ("own ", "own ю") and set(found) == {1, 2, 3} - ({2} if 2 not in found else set())
    assert suffix_array.to_characters([(1, 2), (3, 4)], "áж1".encode()) == [(0, 4)]


@pytest.mark.parametrize(("seed", "letters", "depth"), [(1, 2, 5), (2, 3, 8), (3, 2, 13), (4, 4, 20), (5, 1, 40)])
def test_longest_previous_factors_equal_brute_force(seed, letters, depth):
    symbols = np.random.default_rng(seed).integers(97, 97 + letters, 400).astype(np.uint8)
    at = np.sort(np.random.default_rng(seed).permutation(len(symbols) - depth)[:250])
    place = np.random.default_rng(seed + 9).permutation(len(at))
    rank, levels = suffix_array.suffix_order(symbols, at, depth)
    strings = [bytes(symbols[i : i + depth]) for i in at]
    names = {s: i for i, s in enumerate(sorted(set(strings)))}
    assert np.unique(rank, return_inverse=True)[1].tolist() == [names[s] for s in strings]
    order = np.lexsort((place, rank))
    common = lambda a, b: next((k for k in range(depth) if a[k] != b[k]), depth)
    lcp = suffix_array.common_prefixes(levels, at[order], depth)
    assert lcp.tolist() == [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]
    factors, source = suffix_array.longest_previous_factors(order, lcp, place)
    for i in range(len(at)):
        earlier = [common(strings[i], strings[j]) for j in range(len(at)) if place[j] < place[i]]
        assert factors[i] == max(earlier, default=0)
        assert source[i] == -1 if factors[i] == 0 else place[source[i]] < place[i] and common(strings[i], strings[source[i]]) == factors[i]
    starts = suffix_array.repeated_starts(symbols, at, place, depth, False)
    assert starts.tolist() == [strings.count(x) > 1 for x in strings]


def test_no_suffixes():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in suffix_array.longest_previous_factors(none, none, none)] == [0, 0]


def split_hot_keys(monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLE", 1)
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "ROWS_AT_ONCE", 50)


@pytest.mark.parametrize("length", [400, 100])
def test_common_passages_and_long_texts_are_split_without_a_change(spark, monkeypatch, length):
    split_hot_keys(monkeypatch)
    texts = corpus(11)
    assert digest(suffix_array.remove_repeats(documents(spark, texts), length)) == brute_bytes(texts, length, False)


def test_runs_of_hot_keys_cover_the_same_windows():
    rng = np.random.default_rng(3)
    symbols = np.concatenate([rng.integers(97, 99, 900), np.tile(rng.integers(97, 123, 30), 20)]).astype(np.uint8)
    ends = np.array([500, 1100, 1500])
    shape = repeats.Shape(60, 8, False, True, (9, 2))
    whole = repeats.runs(symbols, ends, shape)
    once = repeats.runs(symbols, ends, shape, (np.unique(whole[0].view(np.uint64)),))
    twice = repeats.runs(symbols, ends, shape, (np.unique(whole[0].view(np.uint64)), np.unique(once[0].view(np.uint64))))
    windows = lambda found: sorted(w for a, b in zip(found[2], found[3], strict=True) for w in range(a, b + 1))
    valid = [i for i in range(1441) if not any(i < e < i + 60 for e in ends[:-1])]
    for found, most in ((whole, 60), (once, 9), (twice, 2)):
        assert windows(found) == valid and (found[3] - found[2] < most).all()
        keys = {}
        for key, a, b in zip(found[0], found[2], found[3], strict=True):
            for w in range(a, b + 1):
                assert keys.setdefault(bytes(symbols[w : w + 60]), key) == key


@pytest.mark.parametrize(("window", "anchor", "subtree", "split"), [(20, 4, 4096, False), (20, 4, 2, True), (7, 2, 3, False)])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, window, anchor, subtree, split):
    if split:
        split_hot_keys(monkeypatch)
    texts = corpus(9)
    split = {i: (t or "").encode().split() for i, (_, t) in enumerate(texts)}
    first = {}
    place = lambda i: (texts[i][0] is None, texts[i][0] or 0)
    for i in split:
        for s in range(len(split[i]) - window + 1):
            key = tuple(split[i][s : s + window])
            first[key] = min(first.get(key, ((True, 1 << 70), 0)), (place(i), s))
    wanted = Counter()
    for i, words in split.items():
        covered = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (place(i), s):
                covered[s : s + window] = True
        kept = b" ".join(w for w, c in zip(words, covered, strict=True) if not c)
        wanted[(texts[i][0], len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest())] += 1
    found = suffix_tree.remove_repeated_windows(documents(spark, texts), window, anchor, subtree)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()) == wanted


def test_repeated_rows_keep_their_first_copies(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(200)]
    first, later = " ".join(words[:120]), " ".join([f"x{i}" for i in range(30)] + words[30:90] + [f"y{i}" for i in range(30)])
    docs = documents(spark, [(1, first), (1, first), (2, later), (3, "alone")])
    found = suffix_tree.remove_repeated_windows(docs).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in found) == {(1, 0): 2, (2, 60): 1, (3, 0): 1}
    kept = suffix_array.cut_later_copies(docs, 100).collect()
    assert [r["text"] for r in kept if r["doc_id"] == 1] == [first, first]


def test_empty_tables(spark):
    none = documents(spark, [])
    for found in (jaccard_join.jaccard_components(none), suffix_array.remove_repeats(none), suffix_tree.remove_repeated_windows(none), suffix_array.cut_later_copies(none), jaccard_join.keep_one(none)):
        assert found.isEmpty()
