"""A log of commands against a step-by-step replay in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from loamline.operators import commands as c
from loamline.operators.scans import in_order, running

TASK = "id long, title string, description string, priority string, completed boolean"
LOG = "seq long, command string, id long, title string, description string, priority string"


def brute(tasks, log):
    kept = {r[0]: list(r[1:]) for r in tasks}
    after, out = max(kept, default=0) + 1, []
    for seq, command, i, title, description, priority in log:
        n = len(kept)
        if command == "add":
            i = None
            if title:
                i, after = after, after + 1
                kept[i] = [title, description, {"low": "Low", "Low": "Low", "high": "High", "High": "High"}.get(priority, "Medium"), False]
            said = c.ADDED if title else c.BROKEN["empty title"]
        elif command not in c.COMMANDS:
            said = c.UNKNOWN
        elif i not in kept:
            said = c.NOT_FOUND if n else c.EMPTY
        elif command == "delete":
            del kept[i]
            said = c.REMOVED
        elif command == "edit":
            wrong = "empty title" if not title else "empty description" if not description else "bad priority" if (priority or "").lower() not in ("low", "medium", "high") else None
            if not wrong:
                kept[i][:3] = [title, description, priority.lower().capitalize()]
            said = c.BROKEN.get(wrong, c.UPDATED)
        else:
            to = command == "complete"
            said = (c.WAS_COMPLETED if to else c.WAS_OPEN) if kept[i][3] == to else c.COMPLETED if to else c.REOPENED
            kept[i][3] = to
        out.append((seq, command, i, said, n))
    return out, sorted((k, *v) for k, v in kept.items())


def random_log(n, seed):
    rng = random.Random(seed)
    kinds = [*c.COMMANDS, "complete", "reopen", "nope", None]
    return [(s, kind := rng.choice(kinds), None if kind == "add" else rng.choice([1, 1, 1, 2, 3, 9, 10, 11, 40, None]), rng.choice(["", "x", None, f"t{s}"]), rng.choice(["", "d"]), rng.choice(["low", "HIGH", "zz", None])) for s in range(n)]


@pytest.mark.parametrize(("n_tasks", "n", "seed"), [(8, 500, 0), (0, 120, 1), (1, 300, 2), (5, 0, 3)])
def test_replay_equals_one_command_after_the_other(spark, n_tasks, n, seed):
    tasks = [(i, f"t{i}", "d", "Low", i % 2 == 0) for i in range(1, n_tasks + 1)]
    log = random_log(n, seed)
    done = c.replay(spark.createDataFrame(tasks, TASK), spark.createDataFrame(random.Random(seed).sample(log, len(log)), LOG))
    outcomes, kept = brute(tasks, log)
    assert sorted(map(tuple, done.outcomes.collect())) == outcomes
    assert sorted(map(tuple, done.tasks.collect())) == kept


def test_a_key_with_most_commands_is_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("key"), (F.col("id") % 3).alias("x"), F.when(F.col("id") % 11 == 0, F.col("id")).alias("mark"))
        placed = in_order(rows.repartition(5), "key", "seq")
        found = running(placed, ["key"], {"total": ("sum", "x"), "last": ("last", "mark")})
        sizes = [r["n"] for r in found.where("key = 7").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 1
        total, last = {}, {}
        for r in sorted(found.collect(), key=lambda r: r["seq"]):
            assert r["total"] == total.get(r["key"], 0) and r["last"] == last.get(r["key"])
            total[r["key"]] = total.get(r["key"], 0) + r["x"]
            last[r["key"]] = r["mark"] if r["mark"] is not None else last.get(r["key"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
