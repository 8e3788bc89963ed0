"""Champion log, promotion rules, drift response and retrain cooldown."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugemill.operators.ordered import with_previous
from gaugemill.session import stage
from gaugemill.settings import PROMOTION_MIN_MARGIN, RETRAIN_COOLDOWN_SECONDS


def decide_action(band: Column) -> Column:
    """significant retrains, moderate alerts, anything else does nothing."""
    return F.when(band == "significant", "retrain").when(band == "moderate", "alert").otherwise("none")


def should_promote(margin: Column, min_margin: float = PROMOTION_MIN_MARGIN) -> Column:
    return F.coalesce(margin >= min_margin, F.lit(False))


def promotion_decision(
    pairs: DataFrame, min_margin: float = PROMOTION_MIN_MARGIN
) -> DataFrame:
    """Rows (champion_macro_f1 or null, candidate_macro_f1) with margin and verdict.

    Without a champion the candidate is bootstrapped.
    """
    margin = F.col("candidate_macro_f1") - F.col("champion_macro_f1")
    return pairs.withColumn("margin", margin).select(
        "*",
        F.when(F.col("champion_macro_f1").isNull(), "bootstrap")
        .when(should_promote(margin, min_margin), "promote")
        .otherwise("keep")
        .alias("decision"),
    )


def challenge(selected: DataFrame, champions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Selected model as A against the live champion as B; without one the selection is forwarded."""
    held = champions.select(
        *keys, F.col("flow_version_id").alias("version_B"), F.col("run_id").alias("model_B")
    )
    return selected.join(held, list(keys), "left").select(
        *keys,
        F.col("flow_version_id").alias("version_A"), F.col("run_id").alias("model_A"),
        "version_B", "model_B",
        F.col("model_B").isNull().alias("forwarded"),
    )


def champion_history(log: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Promotion log with the record each entry replaced: ``previous`` goes one level back."""
    return with_previous(
        log, keys, order, {"previous_version": "flow_version_id", "previous_run_id": "run_id"}
    )


def current_champion(log: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Live champion per key and its rollback target."""
    record = F.struct("flow_version_id", "run_id", "previous_version", "previous_run_id")
    return (
        champion_history(log, keys, order)
        .groupBy(*keys)
        .agg(F.max_by(record, F.struct(*order)).alias("_now"))
        .select(*keys, "_now.*")
        .where(F.col("run_id").isNotNull())
    )


def drop_repeats(log: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Promotion log without entries that promote the model already live."""
    return (
        champion_history(log, keys, order)
        .where(F.col("previous_run_id").isNull() | (F.col("previous_run_id") != F.col("run_id")))
        .select(*log.columns)
    )


def _jump_ends(instants: np.ndarray, window: int) -> np.ndarray:
    """Index of the last accepted instant of the chain starting at each instant."""
    following = np.searchsorted(instants, instants + window)
    end = np.where(following < len(instants), following, np.arange(len(instants)))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end
        end = further


def _per_group(
    df: DataFrame, groups: Sequence[str], order: str,
    function: Callable[[dict[str, np.ndarray]], dict], schema: T.StructType,
) -> DataFrame:
    """Run ``function`` on the column arrays of every group, sorted by ``order``.

    Tasks stream sorted batches and hold one group at a time, which spares the start-up
    cost of a pandas call per group.
    """
    groups = list(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def finish(frames: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(frames, ignore_index=True)
            changes = np.zeros(len(rows), dtype=bool)
            for name in groups:
                changes[1:] |= rows[name].to_numpy()[1:] != rows[name].to_numpy()[:-1]
            edges = [0, *np.flatnonzero(changes).tolist(), len(rows)]
            arrays = {name: rows[name].to_numpy() for name in rows.columns}
            parts = [function({n: a[i:j] for n, a in arrays.items()}) for i, j in zip(edges, edges[1:])]
            return pd.DataFrame({
                name: [value for part in parts for value in part[name]] for name in schema.names
            })

        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            last = np.ones(len(batch), dtype=bool)
            for name in groups:
                last &= (batch[name] == batch[name].iloc[-1]).to_numpy()
            first_of_last = int(np.argmax(last))
            continues = bool(held) and all(held[-1][n].iloc[-1] == batch[n].iloc[-1] for n in groups)
            if first_of_last == 0 and continues:
                held.append(batch)
                continue
            done = held + ([batch.iloc[:first_of_last]] if first_of_last else [])
            if done:
                yield finish(done)
            held = [batch.iloc[first_of_last:]]
        if held:
            yield finish(held)

    return df.repartition(*groups).sortWithinPartitions(*groups, order).mapInPandas(run, schema)


def cooldown(
    requests: DataFrame,
    key: str,
    at: str,
    seq: str,
    seconds: float = RETRAIN_COOLDOWN_SECONDS,
    block_windows: int = 8,
    fan: int = 256,
) -> DataFrame:
    """Mark each request ``accepted`` unless one was accepted less than ``seconds`` before.

    A suppressed request does not restart the clock, so acceptance runs in sequence along
    a key. Keys are cut into time blocks: (1) every block maps the earliest allowed instant
    to its last accepted one, as a short step function; (2) those functions are composed up a
    tree, ``fan`` neighbours at a time, and the starts of blocks are carried down it again;
    (3) every block replays from its now known start. A task holds the distinct instants of
    one key in ``block_windows`` cooldowns, or ``fan`` functions, at a time, however long a key's history is.
    """
    window = int(seconds * 1_000_000)
    span = window * block_windows
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    timed = requests.withColumn(
        "_at", F.timestamp_diff("MICROSECOND", epoch, F.col(at).cast("timestamp_ntz"))
    ).withColumn("_block", ((F.col("_at") - F.pmod("_at", F.lit(span))) / span).cast("bigint"))
    instants = timed.groupBy(key, "_block", "_at").agg(F.min(seq).alias("_seq"))

    def summarize(group: dict[str, np.ndarray]) -> dict:
        times = group["_at"]
        reachable = np.searchsorted(times, group["_block"][0] * span + window) + 1
        ends = times[_jump_ends(times, window)][:reachable]
        last_of_run = np.append(ends[1:] != ends[:-1], True)
        return {key: group[key][:1], "_block": group["_block"][:1],
                "_reach": [group["_block"][0] * span + window], "upto": [times[:reachable][last_of_run]], "ends": [ends[last_of_run]]}

    def compose(group: dict[str, np.ndarray]) -> dict:
        # no start lies beyond the first block's reach, so at most one step of all later blocks takes starts as they are
        upto, ends, reach = group["upto"][0], group["ends"][0], group["_reach"][0]
        for next_upto, next_ends in zip(group["upto"][1:], group["ends"][1:]):
            at_step = np.searchsorted(next_upto, ends + window)
            ends = np.where(at_step < len(next_upto), next_ends[np.minimum(at_step, len(next_upto) - 1)], ends)
            if upto[-1] < reach:
                upto, ends = np.append(upto, next_upto[0]), np.append(ends, next_ends[0])
            last_of_run = np.append(ends[1:] != ends[:-1], True)
            upto, ends = upto[last_of_run], ends[last_of_run]
        return {key: group[key][:1], "_block": group["_up"][:1], "_reach": [reach], "upto": [upto], "ends": [ends]}

    def chain(group: dict[str, np.ndarray]) -> dict:
        earliest, starts = group["_start"][0], []
        for upto, ends in zip(group["upto"], group["ends"]):
            starts.append(earliest)
            at_step = np.searchsorted(upto, earliest)
            if at_step < len(upto):
                earliest = ends[at_step] + window
        return {key: group[key], "_block": group["_block"], "_start": starts}

    def replay(group: dict[str, np.ndarray]) -> dict:
        times, chosen = group["_at"], []
        at_step = np.searchsorted(times, group["_start"][0])
        while at_step < len(times):
            chosen.append(at_step)
            at_step = np.searchsorted(times, times[at_step] + window)
        return {name: group[name][chosen] for name in (key, "_at", "_seq")}

    def schema(**fields: T.DataType) -> T.StructType:
        return T.StructType(
            [T.StructField(key, requests.schema[key].dataType)] + [T.StructField(n, t) for n, t in fields.items()]
        )

    longs, long = T.ArrayType(T.LongType()), T.LongType()
    step_function = schema(_block=long, _reach=long, upto=longs, ends=longs)
    up = F.floor(F.col("_block") / F.lit(fan)).cast("bigint")
    levels = [stage(_per_group(instants, [key, "_block"], "_at", summarize, step_function), "cooldown-steps")]
    while not levels[-1].groupBy(key).count().where("count > 1").isEmpty():
        levels.append(stage(_per_group(levels[-1].withColumn("_up", up), [key, "_up"], "_block", compose, step_function), "cooldown-steps"))
    starts = levels.pop().select(key, "_block", F.lit(int(np.iinfo(np.int64).min)).alias("_start"))
    for level in reversed(levels):  # each level's starts from those of the level above
        parents = starts.withColumnRenamed("_block", "_up")
        starts = _per_group(level.withColumn("_up", up).join(parents, [key, "_up"]), [key, "_up"], "_block", chain, schema(_block=long, _start=long))
    replayed = schema(_at=long, _seq=instants.schema["_seq"].dataType)
    accepted = _per_group(instants.join(starts, [key, "_block"]), [key, "_block"], "_at", replay, replayed).select(
        key, "_at", F.col("_seq").alias(seq), F.lit(True).alias("_accepted")
    )
    return timed.join(accepted, [key, "_at", seq], "left").select(
        *requests.columns, F.coalesce("_accepted", F.lit(False)).alias("accepted")
    )


def adaptation_decisions(measured: DataFrame, key: str, at: str, seq: str, seconds: float = RETRAIN_COOLDOWN_SECONDS) -> DataFrame:
    """Response to every drift measurement (columns band and action); retrains respect the cooldown."""
    retrain = F.col("action") == "retrain"
    judged = cooldown(measured.where(retrain), key, at, seq, seconds).withColumn(
        "action", F.when(F.col("accepted"), "retrain").otherwise("retrain_suppressed_cooldown")
    )
    return measured.where(~retrain).unionByName(judged.drop("accepted"))
