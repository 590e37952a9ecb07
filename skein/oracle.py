"""Decisions that code cannot make: a table of them, consulted only for rows that need one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .operators.intervals import dealt

LONGEST = 10_000
#: what is taken where no decision was made: fixed values
FALLBACKS = {"walk": "new", "coref": "distinct", "type": "(untyped)"}


def decide(rows: DataFrame, decisions: DataFrame, keys: list[str], value: str, fallback: F.Column) -> DataFrame:
    """Joins decided values by key; rows without one get the fallback and are marked."""
    d = decisions.select(*keys, F.col(value).alias("_decided"))
    return rows.join(d, keys, "left").withColumn(value, F.coalesce("_decided", fallback)).withColumn("decided", F.col("_decided").isNotNull()).drop("_decided")


def repeats_at_end(text: str, times: int = 4, least: int = 60) -> bool:
    """Does the text end with the same piece ``times`` over, in ``least`` characters or more?

    The failure function of the reversed text gives the shortest period of every ending in linear time.
    """
    s = text[::-1]
    fail, k = [0] * (len(s) + 1), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = fail[k]
        k += s[i] == s[k]
        fail[i + 1] = k
        n = i + 1
        if n >= least and n >= times * (n - k):
            return True
    return False


def runaway(reply: str | None, longest: int = LONGEST) -> str | None:
    """Why a reply is none: empty, too long, or caught in repetition; null if it is one. Repetition is looked for in the last 4,000 characters."""
    if not reply or not reply.strip():
        return "empty"
    if len(reply) > longest:
        return "too long"
    return "repetition" if repeats_at_end(reply[-4000:]) else None


def ask(rows: DataFrame, model: Callable[[dict], str | None], schema: str, attempts: int = 3, valid: Callable[[dict, str], bool] = lambda row, reply: True, longest: int = LONGEST) -> DataFrame:
    """Puts each row to ``model`` until a reply is valid and no ``runaway``, at most ``attempts`` times; the last reply is kept and flagged.

    ``schema`` is that of ``rows``; the result has reply and ok besides. Narrow ``rows`` to what needs asking first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies, fine = [], []
            for row in pdf.to_dict("records"):
                reply, ok = None, False
                for _ in range(attempts):
                    reply = model(row)
                    ok = runaway(reply, longest) is None and valid(row, reply)
                    if ok:
                        break
                replies.append(reply)
                fine.append(ok)
            yield pdf.assign(reply=replies, ok=fine)

    return rows.mapInPandas(run, f"{schema}, reply string, ok boolean")


def fixpoint(units: DataFrame, keys: list[str], ask_open: Callable[[DataFrame, int], DataFrame], check: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """Draft, check, ask again: (keys, reply, attempts, ok, prompt), one row a unit.

    Each round puts the open ``units`` (with ``draft`` and ``prompt``: the last reply and what is wrong with it, null in the first round) to
    ``ask_open``, which gives (keys, reply); ``check`` turns (keys, reply) into a frame of problems (see ``operators.checks``; codes
    that begin with ``soft`` do not count), and only units with problems go round again, until there are none or after
    ``attempts``; then the last draft is kept, not ok. A unit without a reply has an empty one. A round's drafts are written
    once, since a model may not say the same twice.
    """
    unit = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    none = F.lit(None).cast("string")
    open_, settled = units.withColumns({"draft": none, "prompt": none}), []
    for attempt in range(1, attempts + 1):
        said = open_.select(*keys).join(dealt(ask_open(open_, attempt).select(*keys, "reply")), keys, "left").withColumn("reply", F.coalesce("reply", F.lit("")))
        said = cut(said, "drafts")
        wrong = retries(check(said).where(~F.col("code").startswith("soft"))).withColumnRenamed("unit", "_unit")
        judged = cut(said.withColumn("_unit", unit).join(dealt(wrong), "_unit", "left").drop("_unit"), "judged")
        settled.append(judged.where("prompt is null").select(*keys, "reply", F.lit(attempt).alias("attempts"), F.lit(True).alias("ok"), "prompt"))
        rest = judged.where("prompt is not null")
        if attempt == attempts:
            settled.append(rest.select(*keys, "reply", F.lit(attempt).alias("attempts"), F.lit(False).alias("ok"), "prompt"))
        elif rest.isEmpty():
            break
        else:
            open_ = units.join(dealt(rest.select(*keys, F.col("reply").alias("draft"), "prompt")), keys)
    return reduce(DataFrame.unionByName, settled)


def batches(rows: DataFrame, key: str, size: int = 20, slices: int = 256) -> DataFrame:
    """Adds ``batch``: at most ``size`` rows a batch, numbered within slices of the key's hash, so no task sees all rows."""
    part = F.pmod(F.xxhash64(key), F.lit(slices))
    w = Window.partitionBy("_slice").orderBy(key)
    t = rows.withColumn("_slice", part).withColumn("_n", F.row_number().over(w) - 1)
    return t.withColumn("batch", F.concat_ws("-", "_slice", F.floor(F.col("_n") / size).cast("string"))).drop("_slice", "_n")


def settle(work: DataFrame, known: DataFrame, keys: list[str], value: str, ask_open: Callable[[DataFrame], DataFrame], fallback: F.Column) -> tuple[DataFrame, DataFrame]:
    """(all rows decided, new decisions): rows the table of decisions knows are taken from it, only the others are asked.

    ``ask_open`` gives (keys, value) for rows it can decide; what is still open gets the fallback, marked as not decided.
    """
    new = ask_open(work.join(known.select(*keys), keys, "left_anti")).select(*keys, value)
    return decide(work, known.select(*keys, value).unionByName(new), keys, value, fallback), new


def retries(problems: DataFrame, unit: str = "unit") -> DataFrame:
    """(unit, prompt): what is wrong with a unit's draft, as lines to answer to."""
    line = F.concat(F.lit("- "), "code", F.when(F.col("detail") != "", F.concat(F.lit(": "), "detail")).otherwise(""))
    return problems.groupBy(unit).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("prompt"))
