"""Patterns of successive rows, found by an automaton over ordered partitions.

Each partition is summed up by a map for each key: from every state that it may begin in, the state that it ends in. These
maps, one a partition, are composed in order, and then every partition goes on from its own first state. So a match that
crosses partitions is found, and no task reads all rows of a key.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import number
from .scans import PART, placed

#: (state, symbol): (next state, whether an attempt begins here). What is missing leads to state 0.
Automaton = dict[tuple[int, str], tuple[int, bool]]


def _walk(symbols, automaton: Automaton, state: int, begin):
    """(state, begin) after each symbol; begin is the place of the attempt's first row."""
    for place, symbol in symbols:
        state, fresh = automaton.get((state, symbol), (0, False))
        begin = place if fresh else begin
        yield place, state, begin


def matches(rows: DataFrame, keys: list[str], order: list[str], symbol: str, automaton: Automaton, accept: set[int]) -> DataFrame:
    """(keys, begin, end, n): the attempts that reach a state of `accept`, begin and end the order columns of their first and last row, as structs, and n
    their rows. An attempt that is accepted in several rows gives a match for each. A null symbol is one that the automaton does not know."""
    states = sorted({s for s, _ in automaton} | {s for s, _ in automaton.values()} | {0})
    named = number(rows.select(*keys, *order, F.col(symbol).alias("quire_symbol")), [*keys, *order], "quire_place")
    here = placed(named, keys, order)
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.sort_values("quire_place").groupby(keys, sort=False, dropna=False):
            told = list(zip(own["quire_place"], own["quire_symbol"], strict=True))
            ends = [list(_walk(told, automaton, s, -1))[-1] for s in states]
            out.append([*(own[k].iloc[0] for k in keys), own[PART].iloc[0], [e for _, e, _ in ends], [int(b) for _, _, b in ends]])
        return pd.DataFrame(out, columns=[*keys, PART, "ends", "begins"])

    maps = here.groupBy(PART).applyInPandas(summed, f"{kinds}, {PART} int, ends array<int>, begins array<long>")
    before = F.collect_list(F.struct("ends", "begins")).over(W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1))
    at = F.lit(states)

    def onward(now, m):
        i = F.array_position(at, now["state"]).cast("int")
        begin = F.element_at(m["begins"], i)
        return F.struct(F.element_at(m["ends"], i).alias("state"), F.when(begin >= 0, begin).otherwise(now["begin"]).alias("begin"))

    first = F.aggregate(before, F.struct(F.lit(0).alias("state"), F.lit(-1).cast("long").alias("begin")), onward)
    starts = maps.select(*(F.col(k).alias(f"quire_k{i}") for i, k in enumerate(keys)), F.col(PART).alias("quire_p"), first.alias("quire_first"))
    same = F.col(PART) == F.col("quire_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"quire_k{i}"))
    met = here.join(starts, same).select(*keys, PART, "quire_place", "quire_symbol", F.col("quire_first.state").alias("quire_state"), F.col("quire_first.begin").alias("quire_begin"))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.sort_values("quire_place").groupby(keys, sort=False, dropna=False):
            told = zip(own["quire_place"], own["quire_symbol"], strict=True)
            out += [(int(b), int(p)) for p, s, b in _walk(told, automaton, int(own["quire_state"].iloc[0]), int(own["quire_begin"].iloc[0])) if s in accept]
        return pd.DataFrame(out, columns=["b", "e"]).astype("int64")

    spans = met.groupBy(PART).applyInPandas(found, "b long, e long")
    side = lambda name, place: named.select(F.col("quire_place").alias(place), *((F.col(k) for k in keys) if name == "begin" else ()), F.struct(*order).alias(name))
    return spans.join(side("begin", "b"), "b").join(side("end", "e"), "e").select(*keys, "begin", "end", (F.col("e") - F.col("b") + 1).alias("n"))
