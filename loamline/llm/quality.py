"""Quality rules: fixed limits, and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import by_position, checkpoint, limited, read_table, space_words

#: Words of a repeat window.
REPEAT = 5
#: Share of a group that the covariance is made of, and what scales it to a normal one: for 4 statistics,
#: SHARE / P(chi2 with 6 degrees <= the SHARE quantile of chi2 with 4).
SHARE, CONSISTENCY = 0.75, 1.486
#: Concentration steps; rows as many as which a language's moments weigh in each of its sources; squared distance above which a row
#: goes, which chi-squared with 4 degrees of freedom exceeds 1.2 times in a million.
STEPS, PRIOR_ROWS, CUTOFF = 4, 50, 33.0
#: The statistics and the least standard deviation that each is given, in its transformed unit.
STATISTICS = {"log_word_chars": 0.12, "log_symbols": 0.5, "log_dup_lines": 0.5, "log_repeats": 0.5}
#: Statistics are integers in this unit, so sums are exact and reruns agree.
UNIT = 1000
D = len(STATISTICS)


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``REPEAT`` words that the array holds twice or more, each word once.

    Windows are told apart by a 64-bit hash. Only where some hash comes twice are positions sorted; time grows as
    n log n with the text.
    """
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(1), n - (REPEAT - 1)), lambda i: F.xxhash64(F.slice(words, i, REPEAT)))
    return F.when(n >= REPEAT, grams).otherwise(F.array().cast("array<bigint>"))


def _covered_by_repeats(grams: Column) -> Column:
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    m = F.size(pairs)
    # a window repeats if its hash is that of the one before or after it in sorted order
    before = F.zip_with(F.slice(pairs, 2, m), F.slice(pairs, 1, m - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(before, lambda x: x.isNotNull()))))
    total = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-REPEAT).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(REPEAT), i - acc["last"])).alias("n"), i.alias("last")),
    )
    return total["n"].cast("long")


def judged_by(*columns: Column) -> Column:
    """A hash of what a row's verdict hangs on; nulls are values of their own but for the text, where they are empty."""
    text, *others = columns
    return F.xxhash64(F.coalesce(text, F.lit("")), *[x for c in others for x in (F.coalesce(c, F.lit("")), c.isNull())])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text, lang and source), lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row.

    A null text has no words; its counts are 0, and it fails the base rule, as each text of under 10 words does.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", judged_by(F.col("text"), F.col("lang"), F.col("source")).alias("row"), "lang", "source",
        space_words(F.col("text")).alias("words"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    made = made.select("*", repeated_words(F.col("words")).alias("grams"))
    repeats = F.size("grams") > F.size(F.array_distinct("grams"))
    made = made.select(
        "uid", "doc_id", "row", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(repeats, _covered_by_repeats(F.col("grams"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return made.withColumn("base_failed", failed)


def _vector() -> Column:
    n = F.greatest(F.col("n_words"), F.lit(1))
    rate = lambda c: F.log1p(100.0 * F.col(c) / n)
    parts = [F.log1p(F.col("word_chars") / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return F.array(*[F.round(p * UNIT).cast("long") for p in parts])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, sums and sums of products of x, as exact integers."""
    x = [F.col("x")[i] for i in range(D)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(D)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def _shrunk(moments: DataFrame, prior_rows: int) -> DataFrame:
    """The moments of each language and source, and to them those of ``prior_rows`` rows of the language's moments; a language's stay."""
    own = moments.withColumn("of", F.when(F.size(F.from_json("grp", "array<string>")) == 2, F.to_json(F.array(F.from_json("grp", "array<string>")[0]))))
    sums = [c for c in moments.columns if c not in ("grp", "start", "n")]
    prior = own.where("of is null").select(F.col("grp").alias("l_grp"), F.col("start").alias("l_start"), *[(F.col(c) * (F.lit(float(prior_rows)) / F.col("n"))).alias(f"l_{c}") for c in ("n", *sums)])
    joined = own.join(limited(checkpoint(prior)), (F.col("of") == F.col("l_grp")) & (F.col("start") == F.col("l_start")), "left")
    return joined.select("grp", "start", *[(F.col(c) + F.coalesce(F.col(f"l_{c}"), F.lit(0.0))).alias(c) for c in ("n", *sums)])


def _shape(moments: DataFrame, by: list[str]) -> DataFrame:
    """mean m, lower Cholesky factor l of the floored covariance, and the log of its determinant."""
    floors = list(STATISTICS.values())
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n / UNIT for i in range(D)]
    table = moments.select(*by, *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[
        (F.col(f"p{i}{j}") / n / UNIT**2 - mean[i] * mean[j] + (floors[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i in range(D) for j in range(i + 1)
    ])
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 * 0.01))) if i == j else rest / F.col(f"l{j}{j}")
            table = table.withColumn(f"l{i}{j}", value)
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0))
    return table.select(*by, *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)], (2 * logdet).alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x by forward substitution."""
    z: list[Column] = []
    for i in range(D):
        rest = F.col("x")[i] / F.lit(float(UNIT)) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _concentrate(rows: DataFrame, shape: DataFrame, prior_rows: int) -> DataFrame:
    """One step: the shape of the SHARE of each group's rows that lie nearest by the shape so far.

    Nearest by the distance's logarithm in steps of 1/64, so the cut comes from counts by group and step instead of a
    sort of the group; all rows of the step of the cut belong.
    """
    step = F.floor(F.log(_distance() + F.lit(1e-6)) * 64).cast("int")
    near = rows.join(limited(shape), "grp").select("grp", "start", "x", step.alias("step"))
    counts = near.groupBy("grp", "start", "step").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("grp", "start").orderBy("step")
    enough = F.sum("n").over(order) >= SHARE * F.sum("n").over(Window.partitionBy("grp", "start"))
    cut = counts.withColumn("enough", enough).where("enough").groupBy("grp", "start").agg(F.min("step").alias("cut"))
    kept = near.join(limited(checkpoint(cut)), ["grp", "start"]).where("step <= cut")
    return checkpoint(_shape(_shrunk(checkpoint(_moments(kept, ["grp", "start"])), prior_rows), ["grp", "start"]))


def _starts(rows: DataFrame, prior_rows: int) -> DataFrame:
    """Two first shapes for each group: of all its rows, and of the rows within its middle half in each statistic.

    The quartiles come from counts by value; the values are integers.
    """
    values = rows.select("grp", F.posexplode("x").alias("i", "v")).groupBy("grp", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("grp", "i").orderBy("v")
    share = F.sum("n").over(order) / F.sum("n").over(Window.partitionBy("grp", "i"))
    low, high = F.min(F.when(F.col("share") >= 0.25, F.col("v"))), F.min(F.when(F.col("share") >= 0.75, F.col("v")))
    quartiles = values.withColumn("share", share).groupBy("grp", "i").agg(low.alias("low"), high.alias("high"))
    box = quartiles.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("low", "high")))).alias("box"))
    inside = rows.join(limited(checkpoint(box)), "grp")
    for i in range(D):
        inside = inside.where(F.col("x")[i].between(F.col("box")[i]["low"], F.col("box")[i]["high"]))
    whole = _moments(rows, ["grp"]).withColumn("start", F.lit(0))
    middle = _moments(inside, ["grp"]).withColumn("start", F.lit(1))
    return checkpoint(_shape(_shrunk(checkpoint(whole.unionByName(middle)), prior_rows), ["grp", "start"]))


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The statistics of each row with base_failed, distance and kept.

    Rows that pass the base rule are judged against their language and source, whatever its size. Of the group's transformed
    statistics (log of word length, logs of the rates of symbols, repeated lines and repeated words) the location and
    covariance are those of the ``SHARE`` of its rows with the least determinant, from two fixed starts by ``STEPS``
    concentration steps, with a least variance for each statistic. In every step the language's own moments, found the same way,
    are added with the weight of ``prior_rows`` rows: a source of few rows is judged much as its language is, and one of
    many by itself, without a border between the two. A language of few rows has only them to be judged by. ``distance`` is the squared
    Mahalanobis distance; a row above ``cutoff`` is an outlier and not kept.

    All steps are counts and sums by group with map-side partial sums, so a group may hold most rows. Null language and
    source are values. Null texts count as empty and fail the base rule. Repeated rows are judged alike. Other columns
    are ignored; empty input gives no rows.
    """
    rows = checkpoint(text_statistics(docs).withColumn("x", _vector()))
    judged = rows.where(~F.col("base_failed"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    by_source, by_lang = F.to_json(F.array(name("lang"), name("source"))), F.to_json(F.array(name("lang")))
    known = judged.select(F.explode(F.array(by_source, by_lang)).alias("grp"), "x")
    shape = _starts(known, prior_rows)
    for _ in range(STEPS):
        shape = _concentrate(known, shape, prior_rows)
    first = Window.partitionBy("grp").orderBy("logdet", "start")
    best = shape.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank", "start", "logdet")
    best = limited(checkpoint(best.withColumnRenamed("grp", "b_grp")))
    named = rows.withColumn("grp", F.when(~F.col("base_failed"), by_source)).join(best, F.col("grp") == F.col("b_grp"), "left")
    distance = _distance() / CONSISTENCY
    return named.select(
        "doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(distance > cutoff, F.lit(False))).alias("kept"),
        F.round(distance, 3).alias("distance"),
    )


def keep_quality(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that are not kept, all columns as they are.

    Each row goes by its own verdict, whatever its doc_id: rows are matched to verdicts by doc_id (null is one), text,
    language and source, on which a verdict hangs.
    """
    bad = quality_verdicts(docs, **options).where(~F.col("kept")).select(F.col("doc_id").alias("q_id"), F.col("row").alias("q_row")).distinct()
    plain, doc_id, text, named = by_position(docs)
    row = judged_by(text, *[F.col(f"d{docs.columns.index(c)}") for c in ("lang", "source")])
    return named(plain.join(limited(checkpoint(bad)), doc_id.eqNullSafe(F.col("q_id")) & (row == F.col("q_row")), "left_anti"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``quality_verdicts`` over whole ``documents``."""
    return quality_verdicts(read_table(spark, sf_dir, "documents")).drop("distance", "row")
