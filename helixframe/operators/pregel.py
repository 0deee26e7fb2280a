"""A generic vertex program: supersteps of messages, with combiners, aggregators and phases, on DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.storage import drop, stage

Compute = Callable[[DataFrame, int, dict[str, Any]], DataFrame]
Send = Callable[[DataFrame, int], DataFrame]


def combine(messages: DataFrame, combiners: Mapping[str, Column] | None = None, dst: str = "dst") -> DataFrame:
    """One row a destination: each combiner's aggregate, or without combiners all messages as an array `messages`."""
    if combiners:
        return messages.groupBy(dst).agg(*(c.alias(n) for n, c in combiners.items()))
    rest = [c for c in messages.columns if c != dst]
    return messages.groupBy(dst).agg(F.collect_list(F.struct(*rest)).alias("messages"))


def run(
    vertices: DataFrame,
    compute: Compute,
    send: Send,
    combiners: Mapping[str, Column] | None = None,
    aggregators: Mapping[str, Column] | None = None,
    stop: Callable[[int, dict[str, Any]], bool] = lambda step, found: False,
    phases: int | Callable[[int, DataFrame], bool] = 1,
    max_supersteps: int | None = None,
    report: list[tuple[int, int, int, int]] | None = None,
) -> DataFrame:
    """The vertices (id, state columns, active) when no vertex is active and no message is under way, or stop() says so.

    compute gets the vertices that are active or have messages, with their combined messages (null without), the superstep from
    1, and the aggregates of the step before; it returns them with new state and active. send gets what compute returned and
    gives messages (dst, ...), of which those to unknown ids are dropped. phases: so many times, or while the function of the
    phase from 1 and the vertices is true, all vertices are woken and the supersteps start anew. A phase that needs more than
    max_supersteps, if given, is an error. report: gets (phase, superstep,
    partition, messages) rows. A superstep's tables are deleted when the next state is written.
    """
    if "active" not in vertices.columns:
        vertices = vertices.withColumn("active", F.lit(True))
    state, phase = stage(vertices, "vertices"), 1
    columns, kept = state.columns, state
    go_on = phases if callable(phases) else (lambda number, _: number <= phases)
    while go_on(phase, state):
        if phase > 1:
            state = state.withColumn("active", F.lit(True)).select(*columns)
        messages, found = None, {}
        for step in count(1):
            if max_supersteps is not None and step > max_supersteps:
                raise RuntimeError(f"vertices still active or messages under way after {max_supersteps} supersteps")
            if messages is None:
                computed, idle = state.filter("active"), state.filter("not active")
            else:
                joined = state.join(combine(messages, combiners).withColumnRenamed("dst", "id").withColumn("__has", F.lit(True)), "id", "left")
                due = F.col("active") | F.col("__has").isNotNull()
                computed, idle = joined.filter(due).drop("__has"), joined.filter(~due).select(*columns)
            updated = stage(compute(computed, step, found).select(*columns), "computed")
            if aggregators:
                found = updated.agg(*(c.alias(n) for n, c in aggregators.items())).first().asDict()
            received, messages = messages, stage(send(updated, step), "messages")
            if report is not None:
                sent = messages.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()  # a row a partition
                report.extend((phase, step, p, n) for p, n in sent)
            state = stage(updated.unionByName(idle), "vertices")
            drop(kept, updated, *([received] if received is not None else []))
            kept = state
            if stop(step, found) or (messages.isEmpty() and state.filter("active").isEmpty()):
                break
        drop(messages)
        phase += 1
    return state
