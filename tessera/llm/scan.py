"""Parallel prefix scans over numbered nodes: summaries are folded in groups of up to 64 neighbours, level by level, until
each key has one, and states are handed down again. No group grows with the input, however many nodes a key has."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Bits of a node's number that a level takes: 64 neighbours are folded at once.
BITS = 6
Fold = Callable[[Column], Column]


def levels(most: int) -> list[int]:
    """Shifts of each level over node numbers up to `most`; at least one."""
    out = [BITS]
    while most >> sum(out):
        out.append(BITS)
    return out


def scan(leaves: DataFrame, keys: Sequence[str], shifts: Sequence[int], up: Fold, down: Callable[[Column, Column], Column], first: Column) -> DataFrame:
    """(keys, node, state): what comes to each node from those on its one side.

    leaves: (keys, node: long, s), one row for a node of a key; keys are not null. up folds kids, array<struct<node, s>> in
    order, to one s; down turns kids and the state that comes to all of them into array<struct<node, state>>. The last shift
    must leave one node for each key, to which `first` comes.
    """
    tiers: list[DataFrame] = []
    level = leaves
    for shift in shifts:
        kids = F.array_sort(F.collect_list(F.struct("node", "s"))).alias("kids")
        tiers.append(cut(level.groupBy(*keys, F.shiftright("node", shift).alias("node")).agg(kids)))
        level = tiers[-1].select(*keys, "node", up(F.col("kids")).alias("s"))
    given = tiers[-1].withColumn("state", first)
    for above, tier in zip([None, *reversed(tiers)], reversed(tiers), strict=False):
        given = given if above is None else tier.join(given.hint("merge"), [*keys, "node"])  # neither side is broadcast, as both grow
        given = given.select(*keys, F.explode(down(F.col("kids"), F.col("state"))).alias("kid")).select(*keys, "kid.node", "kid.state")
    return given


def running(effect: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """A `down` that goes through kids in order: effect(state, s) is the state after a kid."""

    def down(kids: Column, state: Column) -> Column:
        none = F.slice(F.transform(kids, lambda k: F.struct(k["node"].alias("node"), state.alias("state"))), 1, 0)
        step = lambda a, k: F.struct(effect(a["state"], k["s"]).alias("state"), F.concat(a["out"], F.array(F.struct(k["node"].alias("node"), a["state"].alias("state")))).alias("out"))
        return F.aggregate(kids, F.struct(state.alias("state"), none.alias("out")), step, lambda a: a["out"])

    return down


def offsets(leaves: DataFrame, shifts: Sequence[int]) -> DataFrame:
    """(node, state: long): the sum of s (long) over all nodes before each."""
    zero = F.lit(0).cast("long")
    return scan(leaves, [], shifts, lambda kids: F.aggregate(kids, zero, lambda a, k: a + k["s"]), running(lambda state, s: state + s), zero)
