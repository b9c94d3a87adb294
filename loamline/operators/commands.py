"""A log of commands against a task list: every command's outcome, and the list after all of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.functions.text import priority_from_input, priority_from_label, task_verdict
from loamline.operators.reports import numbered
from loamline.operators.scans import in_order, running
from loamline.operators.tables import next_id

# What each command says.
EMPTY, NOT_FOUND, UNKNOWN = "No tasks available.", "Task not found.", "Unknown command."
ADDED, REMOVED, UPDATED = "Task added successfully.", "Task removed successfully.", "Task updated successfully."
COMPLETED, REOPENED = "Task completed successfully.", "Task reopened successfully."
WAS_COMPLETED, WAS_OPEN = "Task is already completed.", "Task is already incomplete."
BROKEN = {"empty title": "Task title cannot be empty.", "empty description": "Task description cannot be empty.", "bad priority": "Invalid priority."}

COMMANDS = ["add", "delete", "edit", "complete", "reopen"]


class Replayed(NamedTuple):
    #: seq, command, id, outcome, n_tasks (how many there were before) of each command.
    outcomes: DataFrame
    #: The tasks after the last command.
    tasks: DataFrame


def _with_ids(tasks: DataFrame, log: DataFrame, first_id: int) -> DataFrame:
    """The log with the ids that additions get: those whose rows are in order, by seq, from the id after the highest.

    The counter never falls, so an id that a deletion frees isn't given again inside a log.
    """
    adds = log.where("command = 'add'")
    good = numbered(adds.where(task_verdict(F.col("title"), F.col("description"), F.col("priority"), editing=False) == "ok").select(F.col("seq").alias("_s")), "_s", name="_n")
    start = F.broadcast(next_id(tasks, first_id=first_id).select((F.col("next_id") - 1).alias("_start")))  # one row
    given = good.join(start).select("_s", (F.col("_start") + F.col("_n")).cast(tasks.schema["id"].dataType).alias("_id"))
    joined = log.join(given, F.col("seq") == F.col("_s"), "left")
    return joined.withColumn("id", F.when(F.col("command") == "add", F.col("_id")).otherwise(F.col("id"))).drop("_s", "_id")


def replay(tasks: DataFrame, log: DataFrame, first_id: int = 1) -> Replayed:
    """Do the commands (seq, command, id, title, description, priority) one after the other, by seq, which is unique.

    Commands are add (its id is given here), delete, edit, complete and reopen; each follows the rules of the single change
    and has one outcome: the list is empty, no task has the id, the first rule that its row breaks, already so, or done.
    Ids of ``tasks`` are unique. A null id is found nowhere; an unknown command changes nothing.

    What a command meets hangs on its key alone, and is read off running values: whether the task is there follows from
    the last addition or deletion before it, its fields from the last addition or edit that was accepted, its mark from
    the last of all three. These and the number of tasks are running values in blocks, so neither one key with most of
    the commands nor the whole log holds a task. Tasks that no command names aren't sorted or moved.
    """
    asked = _with_ids(tasks, log.select("seq", "command", F.col("id").cast(tasks.schema["id"].dataType).alias("id"), "title", "description", "priority"), first_id)
    named = asked.select("id").where("id is not null").distinct()
    touched = tasks.join(named, "id", "left_semi")
    begin = touched.select(
        F.lit(None).cast(log.schema["seq"].dataType).alias("seq"), F.lit("begin").alias("command"), "id", "title", "description", "priority", "completed"
    )
    rows = in_order(begin.unionByName(asked.withColumn("completed", F.lit(None).cast("boolean"))), "id", F.col("seq").asc_nulls_first())

    command = F.col("command")
    verdict = task_verdict(F.col("title"), F.col("description"), F.col("priority"), editing=True)
    adding = task_verdict(F.col("title"), F.col("description"), F.col("priority"), editing=False)
    rows = rows.withColumn("_there", F.when(command.isin("begin", "add"), True).when(command == "delete", False))
    rows = running(rows, ["id"], {"_was": ("last", "_there")})
    there = F.coalesce(F.col("_was"), F.lit(False)) & F.col("id").isNotNull()
    new = F.struct("title", "description", F.when(command == "edit", priority_from_input(F.col("priority"))).when(command == "add", priority_from_label(F.col("priority"))).otherwise(F.col("priority")).alias("priority"))
    accepted = command.isin("begin", "add") & F.col("id").isNotNull() | ((command == "edit") & there & (verdict == "ok"))
    mark = F.when(command == "begin", F.col("completed")).when(command == "add", False).when(command == "complete", True).when(command == "reopen", False)
    rows = rows.withColumns({"_fields": F.when(accepted, new), "_mark": F.when(command.isin("begin", "add") | there, mark), "_is": there})
    rows = running(rows, ["id"], {"_had": ("last", "_fields"), "_marked": ("last", "_mark")})
    outcome = (
        F.when(command.isNull() | ~command.isin(COMMANDS), UNKNOWN)
        .when(command == "add", F.when(F.col("id").isNotNull(), ADDED).otherwise(_said(adding)))
        .when(~F.col("_is"), NOT_FOUND)
        .when(command == "delete", REMOVED)
        .when(command == "edit", F.when(verdict == "ok", UPDATED).otherwise(_said(verdict)))
        .when(command == "complete", F.when(F.col("_marked"), WAS_COMPLETED).otherwise(COMPLETED))
        .otherwise(F.when(F.col("_marked"), REOPENED).otherwise(WAS_OPEN))
    )
    rows = rows.withColumn("outcome", outcome)

    moved = F.when(F.col("outcome") == ADDED, 1).when(F.col("outcome") == REMOVED, -1).otherwise(0)
    told = in_order(rows.where("command <> 'begin' or command is null").select("seq", "command", "id", "outcome", moved.alias("_moved")), "seq")
    count = F.broadcast(tasks.agg(F.count(F.lit(1)).alias("_before")))  # one row
    told = running(told, [], {"n_tasks": ("sum", "_moved")}).join(count)
    told = told.withColumn("n_tasks", F.col("n_tasks") + F.col("_before"))
    none = (F.col("n_tasks") == 0) & (F.col("outcome") == NOT_FOUND)
    outcomes = told.select("seq", "command", "id", F.when(none, EMPTY).otherwise(F.col("outcome")).alias("outcome"), F.col("n_tasks").cast("long").alias("n_tasks"))

    now = rows.where("id is not null").groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in ("_there", "_fields", "_mark")])
    changed = now.where("_there").select("id", "_fields.*", F.col("_mark").alias("completed"))
    rest = tasks.join(named, "id", "left_anti")
    return Replayed(outcomes, rest.select("id", "title", "description", "priority", "completed").unionByName(changed))


def _said(verdict):
    said = F.lit(None).cast("string")
    for rule, text in BROKEN.items():
        said = F.when(verdict == rule, text).otherwise(said)
    return said
