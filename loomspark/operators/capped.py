"""Greedy picks under caps, in rounds over all rows instead of a loop over them.

A greedy pick takes what fits and passes over what doesn't.  Up to the first misfit that is a running sum that stays within its
limit, so one round finds it for all segments at once.  Limits only fall: what no longer fits after a round never will, and goes;
the next round starts behind.  Rounds are few, as each misfit leaves less room than it needed.  Sums run along written places by
blocks, so no source, family or class is ever put into one task.  Each round is written as a table, which keeps the planner's
sizes of the next one small.  When at most LOCAL_ROWS rows are left, the driver ends the pick by a loop.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.places import placed, running
from .registry import query

LOCAL_ROWS = 10_000


def hashed(salt: str, *parts) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)


def within(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (source, place, q, ...) that each source takes under its own limit alone, with turn: which of its picks it is.

    limits: source, room, turn (the picks before).
    """
    taken, kept = [], [c for c in rows.columns]
    while True:
        summed = running(rows, ["source"], "place", total=F.col("q"), n=F.lit(1)).join(limits, "source")
        summed = written(summed.select(*kept, "total", "n", "room", "turn"))
        good = summed.where("total <= room")
        taken.append(good.select(*kept, (F.col("turn") + F.col("n")).alias("turn")))
        used = good.groupBy("source").agg(F.max("total").alias("used"), F.max("n").alias("picks"))
        limits = written(limits.join(used, "source", "left").select("source", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), (F.col("turn") + F.coalesce("picks", F.lit(0))).alias("turn")))
        rows = summed.where("total > room").select(*kept).join(limits.select("source", F.col("room").alias("_room")), "source").where("q <= _room").select(*kept)
        if not rows.head(1):
            return reduce(DataFrame.unionByName, taken)


def round_robin(df: DataFrame, source: str, key: str, weight: str, cap: int, budget: int, salt: str = "w7", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """key, source, weight and place of what is picked, in turn from each source.

    Sources come in hash order, rows of a source in hash order of their key.  At its turn a source takes its next row that keeps it
    within ``cap`` and the total within ``budget``; rows it passes over are lost.  Null weights count as 0, a null source as the
    empty name; rows that repeat a key stand in any order.  No rows: no rows out.
    """
    name, spark = F.coalesce(F.col(source), F.lit("")), df.sparkSession
    rows = df.select(name.alias("source"), F.col(key).alias("key"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("q"), hashed(salt, F.col(key).cast("string")).alias("h"))
    order = written(placed(rows.select("source").distinct().withColumn("h", hashed(salt, "source", F.col("source"))), F.col("h"), F.col("source"), name="o").select("source", "o"))
    rows = placed(rows.join(order, "source"), F.col("o"), F.col("h"), F.col("key")).select("source", "o", "key", "q", "place")
    state = order.select("source", "o", F.lit(cap).cast("long").alias("room"), F.lit(0).cast("long").alias("turn"))
    left, picked, rounds = budget, [], 0
    while True:
        rows = written(rows.join(state.select("source", "room"), "source").where((F.col("q") <= F.col("room")) & (F.col("q") <= left)).drop("room"))
        some = rows.limit(local_rows + 1).count()
        if not some:
            break
        if rounds and some <= local_rows:
            picked.append(spark.createDataFrame(_loop(rows.collect(), {r["source"]: (r["o"], r["room"], r["turn"]) for r in rows.select("source").distinct().join(state, "source").collect()}, left), "source string, key string, q long, turn long, o long").withColumn("key", F.col("key").cast(df.schema[key].dataType)))
            break
        rounds += 1
        sure = placed(within(rows, state.select("source", "room", "turn")).withColumnRenamed("place", "own"), F.col("turn"), F.col("o"), name="at")
        sure = written(running(sure, [], "at", total=F.col("q")))
        misfit = sure.where(F.col("total") > left).orderBy("at").select("at", "turn", "o").first()
        good = sure if misfit is None else sure.where(F.col("at") < misfit["at"])
        picked.append(good.select("source", "key", "q", "turn", "o"))
        if misfit is None:
            break
        left -= good.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0]
        # from here on no row of a source that was picked or passed over counts; the misfit's source goes on in the same turn
        passed = good.groupBy("source").agg(F.sum("q").alias("used"), F.max("own").alias("upto"))
        state = written(state.join(passed, "source", "left").select("source", "o", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), F.when(F.col("o") >= misfit["o"], misfit["turn"] - 1).otherwise(misfit["turn"]).cast("long").alias("turn"), F.coalesce("upto", F.lit(-1)).alias("upto")))
        rows = rows.join(state.select("source", "upto"), "source").where((F.col("place") > F.col("upto")) & ~((F.col("o") == misfit["o"]) & (F.col("q") > left))).drop("upto")
        state = state.drop("upto")
    if not picked:
        return spark.createDataFrame([], df.select(F.col(key), F.lit("").alias("source"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("place")).schema)
    out = placed(reduce(DataFrame.unionByName, picked), F.col("turn"), F.col("o"))
    return out.select(F.col("key").alias(key), "source", F.col("q").alias("weight"), "place")


def _loop(rows: list, state: dict, left: int) -> list[tuple]:
    """The rest of the pick, one row after the other; state: place in the order of sources, room, and turns taken."""
    queues = {s: deque() for s, _ in sorted(state.items(), key=lambda x: x[1][0])}
    for r in sorted(rows, key=lambda r: r["place"]):
        queues[r["source"]].append((r["key"], r["q"]))
    room, out = {s: x[1] for s, x in state.items()}, []
    turn = min(x[2] for x in state.values())
    while any(queues.values()):
        turn += 1
        for s, q in queues.items():
            if state[s][2] >= turn:
                continue
            while q:
                k, n = q.popleft()
                if n <= room[s] and n <= left:
                    room[s], left = room[s] - n, left - n
                    out.append((s, str(k), n, turn, state[s][0]))
                    break
    return out


def whole_families(df: DataFrame, family: str, cls: str, key: str, quota: dict[str, int], per_family: int | None = None, salt: str = "w8") -> DataFrame:
    """key, family, cls and whole of what fills the quotas of the classes.

    Families come in hash order, rows of a family in hash order of their key.  First whole families (their first ``per_family``
    rows) that fit into what is left of every class, then single rows of the families left over, at most ``per_family`` of each.
    Null families and null keys are left out; classes without a quota have none.  Quotas are few and on the driver.
    """
    few = per_family if per_family is not None else 1 << 62
    names = {c: f"c{i}" for i, c in enumerate(sorted(quota))}
    rows = df.where(F.col(family).isNotNull() & F.col(key).isNotNull()).select(F.col(family).alias("family"), F.col(cls).alias("cls"), F.col(key).alias("key"))
    rows = rows.withColumn("fh", hashed(salt, F.col("family").cast("string"))).withColumn("h", hashed(salt, F.col("key").cast("string")))
    rows = placed(rows, F.col("fh"), F.col("family"), F.col("h"), F.col("key")).select("family", "cls", "key", "place")
    rows = written(running(rows, ["family"], "place", nth=F.lit(1)))
    first = rows.where(F.col("nth") <= few)
    need = [F.count_if(F.col("cls") == c).alias(x) for c, x in names.items()]
    families = first.groupBy("family").agg(F.min("place").alias("place"), F.count("*").alias("all"), *need)
    families = families.where(F.col("all") == sum((F.col(x) for x in names.values()), F.lit(0)))
    left, whole = dict(quota), []
    while True:
        fits = reduce(Column.__and__, (F.col(x) <= left[c] for c, x in names.items()), F.lit(True))
        families = written(families.where(fits))
        if not families.head(1):
            break
        sums = written(running(families, [], "place", **{f"s_{x}": F.col(x) for x in names.values()}))
        good = reduce(Column.__and__, (F.col(f"s_{x}") <= left[c] for c, x in names.items()), F.lit(True))
        whole.append(sums.where(good).select("family"))
        used = sums.where(good).agg(*(F.coalesce(F.max(f"s_{x}"), F.lit(0)).alias(x) for x in names.values())).first()
        left = {c: left[c] - used[x] for c, x in names.items()}
        families = sums.where(~good).select(*families.columns)
    taken = written(reduce(DataFrame.unionByName, whole)) if whole else rows.select("family").limit(0)
    out = [first.join(taken, "family", "left_semi").select("key", "family", "cls", "place", F.lit(True).alias("whole"))]

    rest = rows.join(taken, "family", "left_anti").select("family", "cls", "key", "place")
    upto, last, got = -1, None, 0  # what is decided, and the family in which that ends, with its rows so far
    while open_ := {c: n for c, n in left.items() if n > 0}:
        rest = written(rest.where(F.col("place") > upto).where(F.col("cls").isin([*open_])))
        ranked = running(rest, ["family"], "place", nth=F.lit(1))
        ranked = ranked.where(F.col("nth") + F.when(F.col("family") == F.lit(last), got).otherwise(0) <= few) if last is not None else ranked.where(F.col("nth") <= few)
        able = written(running(ranked, ["cls"], "place", n=F.lit(1)))
        full = reduce(Column.__or__, ((F.col("cls") == c) & (F.col("n") == n) for c, n in open_.items()))
        end = able.where(full).agg(F.min("place")).first()[0]
        now = able if end is None else able.where(F.col("place") <= end)
        out.append(now.select("key", "family", "cls", "place", F.lit(False).alias("whole")))
        if end is None:
            break
        for r in now.groupBy("cls").count().collect():
            left[r["cls"]] -= r["count"]
        at = able.where(F.col("place") == end).first()["family"]
        mine = now.where(F.col("family") == F.lit(at)).count()
        upto, last, got = end, at, mine + (got if at == last else 0)
    return reduce(DataFrame.unionByName, out).select(F.col("key").alias(key), F.col("family").alias(family), F.col("cls").alias(cls), "whole")


@query("W07_capped_round_robin")
def capped_round_robin(spark, sf_dir):
    """Documents in turn from each source: a quarter of all characters, at most a fifth of that from one source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    budget = (docs.agg(F.sum("n_chars")).first()[0] or 0) // 4
    return round_robin(docs, "source", "doc_id", "n_chars", cap=budget * 2 // 10, budget=budget)


@query("W08_whole_family_quota")
def family_quota(spark, sf_dir):
    """A quarter of the documents of each language, by families of neighbouring ids of a source, at most four of a family."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("family", F.concat_ws("/", "source", F.floor(F.col("doc_id") / 200)))
    quota = {r["lang"]: r["count"] // 4 for r in docs.where("lang IS NOT NULL").groupBy("lang").count().collect()}
    return whole_families(docs, "family", "lang", "doc_id", quota, per_family=4)
