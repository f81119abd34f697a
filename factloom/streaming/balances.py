"""Balances with the never-negative rule: a hold is accepted only when the credits are
there, so a user's movements must be applied in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import ordered
from ..operators.stats import union_all
from ..session import cut_lineage

#: A block of so many movements is what one task replays; one row for each reaches the driver.
BLOCK_ROWS = 1_000_000
#: Users with more blocks in which something is rejected are folded one movement after the other.
ROUNDS = 24
GRANTS = ("signup_bonus", "purchase")
OUTCOME = "id bigint, user_id bigint, accepted boolean, available bigint, held bigint"
ORDER = ["ts", "id"]
STARTS = "user_id bigint, block bigint, a bigint, h bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(kind: str, amount: int, available: int, held: int) -> tuple[bool, int, int]:
    """One movement: (accepted, available, held). A hold needs the credits, a capture or
    release needs an open hold."""
    size = abs(amount)
    if kind in GRANTS:
        return True, available + size, held
    if kind == "report_hold":
        return (True, available - size, held + size) if available >= size else (False, available, held)
    if held < size:
        return False, available, held
    return True, available + (size if kind == "report_release" else 0), held - size


def settle_rows(kinds: np.ndarray, amounts: np.ndarray, available: int, held: int, step: int = 512):
    """``settle`` for movements in their order: (accepted, available, held) after each. As long as none is
    rejected, balances are running sums; a hold is rejected where they would fall below zero, a capture or
    release where open holds would. Sums start anew behind a rejected row."""
    size = np.abs(amounts.astype(np.int64))
    grant, hold, release = np.isin(kinds, GRANTS), kinds == "report_hold", kinds == "report_release"
    more = np.where(hold, -size, np.where(grant | release, size, 0))
    open_holds = np.where(hold, size, np.where(grant, 0, -size))
    accepted = np.ones(len(size), bool)
    out_a, out_h = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    at = 0
    while at < len(size):
        to = min(at + step, len(size))
        a, h = available + np.cumsum(more[at:to]), held + np.cumsum(open_holds[at:to])
        wrong = np.flatnonzero(np.where(hold[at:to], a < 0, ~grant[at:to] & (h < 0)))
        good = int(wrong[0]) if len(wrong) else to - at
        out_a[at:at + good], out_h[at:at + good] = a[:good], h[:good]
        if good:
            available, held = int(a[good - 1]), int(h[good - 1])
        at += good
        if len(wrong):
            accepted[at], out_a[at], out_h[at] = False, available, held
            at += 1
    return accepted, out_a, out_h


def _apply(frame: pd.DataFrame, user, available: int, held: int):
    frame = frame.sort_values(ORDER)
    accepted, a, h = settle_rows(frame["entry_type"].to_numpy(), frame["amount"].to_numpy(), available, held)
    out = pd.DataFrame({"id": frame["id"].to_numpy(), "user_id": user, "accepted": accepted, "available": a, "held": h})
    return (out, int(a[-1]), int(h[-1])) if len(a) else (out, available, held)


class _Balance(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "available bigint, held bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        available, held = self.balance.get() if self.balance.exists() else (0, 0)
        # One user's share of one micro-batch: give the source a maxBytesPerTrigger of about
        # a gigabyte. Backlogs go through ``balance_batch``, which holds no user in memory.
        out, available, held = _apply(pd.concat(list(rows)), key[0], int(available), int(held))
        self.balance.update((available, held))
        yield out

    def close(self) -> None:
        pass


def balance_stream(movements: DataFrame) -> DataFrame:
    """(id, user_id, accepted, available, held) for each movement (id, user_id, ts,
    entry_type, amount). State is two numbers per user."""
    movements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return movements.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Balance(), outputStructType=OUTCOME, outputMode="append", timeMode="none")


def balance_batch(movements: DataFrame, block_rows: int = BLOCK_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The same on stored data. Users of up to ``block_rows`` movements are folded one after the other, in
    Arrow batches of sorted rows with two numbers of state. Longer histories are cut into blocks, see
    ``_by_blocks``. A null user is a user."""
    rows = movements.select("id", "user_id", "ts", "entry_type", "amount")
    busy = cut_lineage(rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("user_id"), "busy")
    if busy.isEmpty():
        return _folded(rows, {})
    marked = ordered.join_keys(rows, busy.withColumn("busy", F.lit(True)), ["user_id"], "left")
    rest = _folded(marked.where("busy is null").drop("busy"), {})
    return rest.unionByName(_by_blocks(marked.where("busy").drop("busy"), block_rows, rounds))


def _folded(rows: DataFrame, start: dict) -> DataFrame:
    """Movements in order, each user from ``start`` or from nothing."""
    def fold(frames):
        user, available, held, begun = None, 0, 0, False
        for frame in frames:
            parts = []
            for key, own in frame.groupby("user_id", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if key != user or not begun:
                    user, (available, held), begun = key, start.get(key, (0, 0)), True
                out, available, held = _apply(own, key, available, held)
                parts.append(out)
            if parts:
                yield pd.concat(parts)

    return rows.repartition("user_id").sortWithinPartitions("user_id", *ORDER).mapInPandas(fold, OUTCOME)


def _by_blocks(rows: DataFrame, block_rows: int, rounds: int) -> DataFrame:
    """Histories in blocks of ``block_rows`` movements. A block's lowest running sums tell from which
    balances on it rejects nothing; such a block only adds to the balances, and its rows are running sums from its
    start. The first block of each user that could reject is replayed from its known start, all users side by side;
    then the search goes on behind it. Users with more than ``rounds`` such blocks are folded on from there."""
    spark = rows.sparkSession
    size, kind = F.abs("amount"), F.col("entry_type")
    hold, grant = kind == "report_hold", kind.isin(*GRANTS)
    cut = ordered.numbered(rows, ["user_id"], ORDER, "rn", block_rows).withColumns({
        "block": F.floor((F.col("rn") - 1) / block_rows).cast("bigint"),
        "more": F.when(hold, -size).when(grant | (kind == "report_release"), size).otherwise(0).cast("bigint"),
        "open": F.when(hold, size).when(grant, 0).otherwise(-size).cast("bigint")})
    within = Window.partitionBy("user_id", "block").orderBy("rn")
    cut = cut_lineage(cut.withColumns({"sum_a": F.sum("more").over(within), "sum_h": F.sum("open").over(within)}), "blocks")
    # One row for each block of block_rows movements reaches the driver, five numbers each.
    blocks: dict = {}
    for r in cut.groupBy("user_id", "block").agg(
            F.coalesce(F.min(F.when(hold, F.col("sum_a"))), F.lit(0)).alias("low_a"), F.coalesce(F.min(F.when(~hold & ~grant, F.col("sum_h"))), F.lit(0)).alias("low_h"),
            F.sum("more").alias("a"), F.sum("open").alias("h")).orderBy("block").toLocalIterator():
        blocks.setdefault(r.user_id, []).append(r)
    state = {user: (0, 0, 0) for user in blocks}  # next block, available, held
    safe, replayed, tails = [], [], {}
    for turn in range(rounds + 1):
        asked = []
        for user, (k, a, h) in state.items():
            own = blocks[user]
            while k < len(own) and a + own[k].low_a >= 0 and h + own[k].low_h >= 0:
                safe.append((user, own[k].block, a, h))
                k, a, h = k + 1, a + own[k].a, h + own[k].h
            state[user] = k, a, h
            if k < len(own):
                asked.append((user, own[k].block, a, h))
        if not asked:
            break
        if turn == rounds:
            tails = {user: (block, a, h) for user, block, a, h in asked}
            break
        part = cut_lineage(_replayed(ordered.join_keys(cut, spark.createDataFrame(asked, STARTS), ["user_id", "block"])), "replayed")
        replayed.append(part)
        ends = {r.user_id: r for r in part.groupBy("user_id").agg(F.max_by(F.struct("available", "held"), "rn").alias("x")).select("user_id", "x.*").collect()}
        state = {user: (state[user][0] + 1, ends[user].available, ends[user].held) for user, *_ in asked}
    names = ["id", "user_id", "accepted", "available", "held"]
    known = ordered.join_keys(cut, spark.createDataFrame(safe, STARTS), ["user_id", "block"])
    parts = [known.select("id", "user_id", F.lit(True).alias("accepted"), (F.col("a") + F.col("sum_a")).alias("available"), (F.col("h") + F.col("sum_h")).alias("held"))]
    parts += [part.select(*names) for part in replayed]
    if tails:
        begins = spark.createDataFrame([(user, block) for user, (block, _, _) in tails.items()], "user_id bigint, first bigint")
        rest = ordered.join_keys(cut, begins, ["user_id"]).where(F.col("block") >= F.col("first")).select(*rows.columns)
        parts.append(_folded(rest, {user: (a, h) for user, (_, a, h) in tails.items()}))
    return union_all(parts)


def _replayed(blocks: DataFrame) -> DataFrame:
    """Outcome rows, with rn, of blocks whose start is known; a block is one task's work."""
    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        accepted, a, h = settle_rows(frame["entry_type"].to_numpy(), frame["amount"].to_numpy(), int(frame["a"].iloc[0]), int(frame["h"].iloc[0]))
        return pd.DataFrame({"id": frame["id"].to_numpy(), "user_id": frame["user_id"].to_numpy(), "accepted": accepted,
                             "available": a, "held": h, "rn": frame["rn"].to_numpy()})

    return blocks.groupBy("user_id", "block").applyInPandas(replay, OUTCOME + ", rn bigint")
