"""Greedy chains and small state machines along a key, in passes of bounded memory.

Both operators read key-sorted partitions in Arrow batches and carry the state of the current key from
batch to batch, so a task holds one batch whatever the size of a key. Only keys with more than
``block_rows`` rows are cut into blocks, so that no key keeps one task busy for long: a first pass
computes what each block does to every state that may enter it, a short fold along the blocks of a key
finds the state that does enter, and the last pass starts each block from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.operators.ordered import DAY, micros, time_chunk

BLOCK_ROWS = 100_000


def key_text(keys: Sequence[str]) -> Column:
    """One text per key; the parts are told apart by their lengths, NULL included."""
    parts = []
    for k in keys:
        text = F.col(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges in which all columns keep their value."""
    n = len(columns[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = np.concatenate(([0], np.flatnonzero(change) + 1, [n]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _sorted_by(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def _with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _next_index(t: np.ndarray, gap: int, strict: bool) -> np.ndarray:
    return np.searchsorted(t, t + gap, side="right" if strict else "left")


def leading_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    gap_s: float,
    *,
    strict: bool = False,
    chunk_s: float = DAY,
    block_rows: int = BLOCK_ROWS,
    out: str = "is_leader",
) -> DataFrame:
    """Flag the leaders of each key: first row, then each first row with ``ts - leader >= gap_s``
    (``>`` when ``strict``). The blocks of a long key are its time slices: chains that start at
    different rows soon meet, so what a slice does to an incoming leader is a short step function."""
    gap = micros(gap_s)
    side = "right" if strict else "left"
    names, order = list(df.columns), list(order)
    base = df.withColumn("_k", key_text(keys)).withColumn("_t", F.unix_micros(F.col(ts)))
    base = base.withColumn("_slice", time_chunk(ts, max(chunk_s, gap_s)))
    long_keys = base.groupBy("_k").count().filter(F.col("count") > block_rows).select("_k")
    schema = _with_field(df, out, T.BooleanType())

    def walk(batches: Iterator[pd.DataFrame], by_slice: bool) -> Iterator[pd.DataFrame]:
        at, leader = None, None
        for pdf in batches:
            t_all, ks = pdf["_t"].to_numpy(), pdf["_k"].to_numpy()
            slices = pdf["_slice"].to_numpy() if by_slice else np.zeros(len(pdf), dtype=np.int64)
            flag = np.zeros(len(pdf), dtype=bool)
            for lo, hi in _runs(ks, slices):
                if (ks[lo], slices[lo]) != at:
                    at = (ks[lo], slices[lo])
                    came = pdf["_carry"].iloc[lo] if by_slice else None
                    leader = None if came is None or pd.isna(came) else int(came)
                t = t_all[lo:hi]
                i = 0 if leader is None else int(np.searchsorted(t, leader + gap, side=side))
                while i < len(t):
                    flag[lo + i] = True
                    leader = int(t[i])
                    i = int(np.searchsorted(t, leader + gap, side=side))
            rows = pdf[names].copy()
            rows[out] = flag
            yield rows

    cold = _sorted_by(base.join(long_keys, "_k", "left_anti").select(*names, "_k", "_t"), ["_k"], ["_t", *order])
    short = cold.mapInPandas(lambda b: walk(b, False), schema)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def line() -> pd.DataFrame:
            t = np.concatenate(held)
            nxt = _next_index(t, gap, strict)
            # chains reachable from outside enter within one gap of the slice start
            entries = min(len(t), int(np.searchsorted(t, t[0] + gap, side="right")) + 1)
            last = np.empty(len(t), dtype=np.int64)
            for i in range(len(t) - 1, -1, -1):
                last[i] = last[nxt[i]] if nxt[i] < len(t) else t[i]
            run = last[:entries]
            ends = np.append(np.flatnonzero(run[1:] != run[:-1]), entries - 1)
            return pd.DataFrame({
                "_k": [at[0]], "_slice": [at[1]], "upto": [t[:entries][ends].tolist()], "leader": [run[ends].tolist()], "own_last": [int(last[0])],
            })

        for pdf in batches:
            ks, slices, t_all = (pdf[c].to_numpy() for c in ("_k", "_slice", "_t"))
            for lo, hi in _runs(ks, slices):
                if (ks[lo], slices[lo]) != at:
                    if held:
                        yield line()
                    at, held = (ks[lo], slices[lo]), []
                held.append(t_all[lo:hi])
        if held:
            yield line()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slice", kind="stable")
        state, got = None, []
        for upto, leader, own in pdf[["upto", "leader", "own_last"]].itertuples(index=False, name=None):
            got.append(state)
            if state is None:
                state = int(own)
            else:
                i = int(np.searchsorted(np.asarray(upto), state + gap, side=side))
                state = int(leader[i]) if i < len(upto) else state
        return pd.DataFrame({"_k": pdf["_k"], "_slice": pdf["_slice"], "_carry": pd.array(got, dtype="Int64")})

    hot = base.join(long_keys, "_k", "left_semi")
    narrow = _sorted_by(hot.select("_k", "_slice", "_t"), ["_k", "_slice"], ["_t"])
    carried = narrow.mapInPandas(steps, "_k string, _slice long, upto array<long>, leader array<long>, own_last long")
    carried = carried.groupBy("_k").applyInPandas(fold, "_k string, _slice long, _carry long")
    placed = _sorted_by(hot.select(*names, "_k", "_t", "_slice").join(carried, ["_k", "_slice"]), ["_k", "_slice"], ["_t", *order])
    return short.unionByName(placed.mapInPandas(lambda b: walk(b, True), schema))


def block_machine(
    df: DataFrame,
    keys: Sequence[str],
    rn: str,
    inputs: Sequence[str],
    step: Callable[[tuple, tuple], tuple],
    initial: tuple,
    states: Sequence[tuple],
    output: Callable[[tuple], int],
    *,
    block_rows: int = BLOCK_ROWS,
    out: str = "state_out",
) -> DataFrame:
    """Run a finite-state machine along ``rn`` (from 1) of each key.

    ``step(state, input_row)`` gives the next state. Block 0 of a key starts from ``initial``. For the
    further blocks of a long key, the distinct states still alive are stepped together and soon coincide.
    """
    names, inputs = list(df.columns), list(inputs)
    base = df.withColumn("_k", key_text(keys)).withColumn("_block", F.floor((F.col(rn) - 1) / block_rows).cast("long"))
    all_states = [tuple(s) for s in states]
    index = {s: i for i, s in enumerate(all_states)}
    long_keys = base.filter(F.col("_block") == 1).select("_k").distinct()

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, alive, where = None, [], []
        line = lambda: pd.DataFrame({"_k": [at[0]], "_block": [at[1]], "to": [[index[alive[i]] for i in where]]})
        for pdf in batches:
            values = list(pdf[inputs].itertuples(index=False, name=None))
            ks, blocks = pdf["_k"].to_numpy(), pdf["_block"].to_numpy()
            for lo, hi in _runs(ks, blocks):
                if (ks[lo], blocks[lo]) != at:
                    if at is not None:
                        yield line()
                    at = (ks[lo], blocks[lo])
                    entry = [initial] if blocks[lo] == 0 else all_states
                    alive = list(dict.fromkeys(entry))
                    slot = {s: i for i, s in enumerate(alive)}
                    where = [slot[s] for s in entry]
                for x in values[lo:hi]:
                    moved = [step(s, x) for s in alive]
                    alive = list(dict.fromkeys(moved))
                    if len(alive) < len(moved):
                        slot = {s: i for i, s in enumerate(alive)}
                        to = [slot[s] for s in moved]
                        where = [to[i] for i in where]
        if at is not None:
            yield line()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", kind="stable")
        state, got = index[initial], []
        for block, to in pdf[["_block", "to"]].itertuples(index=False, name=None):
            got.append(state)
            state = int(to[0]) if block == 0 else int(to[state])
        return pd.DataFrame({"_k": pdf["_k"], "_block": pdf["_block"], "_carry": got})

    hot = base.join(long_keys, "_k", "left_semi").select("_k", "_block", rn, *inputs)
    carried = _sorted_by(hot, ["_k", "_block"], [rn]).mapInPandas(maps, "_k string, _block long, to array<int>")
    carried = carried.groupBy("_k").applyInPandas(fold, "_k string, _block long, _carry int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, initial
        for pdf in batches:
            values = list(pdf[inputs].itertuples(index=False, name=None))
            ks, blocks, carry = pdf["_k"].to_numpy(), pdf["_block"].to_numpy(), pdf["_carry"].to_numpy()
            res = np.empty(len(pdf), dtype=np.int32)
            for lo, hi in _runs(ks, blocks):
                if (ks[lo], blocks[lo]) != at:
                    at = (ks[lo], blocks[lo])
                    state = initial if blocks[lo] == 0 else all_states[int(carry[lo])]
                for i in range(lo, hi):
                    state = step(state, values[i])
                    res[i] = output(state)
            rows = pdf[names].copy()
            rows[out] = res
            yield rows

    started = base.join(carried, ["_k", "_block"], "left")
    return _sorted_by(started, ["_k", "_block"], [rn]).mapInPandas(run, _with_field(df, out, T.IntegerType()))
