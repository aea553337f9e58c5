"""Text that flows through a chain of linked boxes.

Where a line ends depends on where it starts, so lines seem to follow one another in one task. Here every word is asked, for each width of its chain, where the
line that starts with it would end. These answers lie in blocks of words; a task follows the lines from each word that a line of an earlier block leads to, until they leave the block.
Only these steps from block to block are composed by doubling, so rounds handle a few rows a block and not all words. All blocks that a stretch of boxes of one
width leads through are found in rounds of the logarithm of their number, and their tasks then give out the lines.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .scans import last_known, running, shifted


def _numbered(words: DataFrame, keys: list[str], order: list[str], size: str, gap: int) -> DataFrame:
    """(keys, pos, quire_start, quire_end): words numbered from 0, and their places on an endless line, each followed by a gap."""
    room = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long") + gap
    known = words.select(*keys, *order, room.alias("quire_room"), F.lit(1).cast("long").alias("quire_one"))
    places = running(running(known, keys, order, "quire_one", "quire_pos"), keys, order, "quire_room", "quire_end")
    return places.select(*keys, (F.col("quire_pos") - 1).alias("pos"), (F.col("quire_end") - F.col("quire_room")).alias("quire_start"), "quire_end")


def _chains(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """boxes (keys, box, box_width, lines) with `quire_run`, the stretch of boxes of one width, from 1, and `quire_from`, the lines before the box in it."""
    full = boxes.filter("box_width IS NOT NULL AND lines > 0").select(*keys, "box", F.col("box_width").cast("long").alias("box_width"), F.col("lines").cast("long").alias("lines"))
    met = shifted(full, keys, ["box"], "box_width", "quire_last").withColumn("quire_new", (~F.col("box_width").eqNullSafe(F.col("quire_last"))).cast("long"))
    runs = running(met.drop("quire_last"), keys, ["box"], "quire_new", "quire_run").drop("quire_new")
    return cut(running(runs, [*keys, "quire_run"], ["box"], "lines", "quire_upto").withColumn("quire_from", F.col("quire_upto") - F.col("lines")).drop("quire_upto"))


def _next(words: DataFrame, widths: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """(keys, box_width, pos, next): the word that starts the line after the one that starts at pos. Ends of words and the places where lines must end are sorted together."""
    ends = words.select(*keys, F.col("quire_end").alias("quire_at"), F.lit(0).alias("quire_kind"), F.lit(0).cast("long").alias("box_width"), "pos", (F.col("pos") + 1).alias("quire_own"))
    asked = words.join(widths, keys).select(*keys, (F.col("quire_start") + F.col("box_width") + gap).alias("quire_at"), F.lit(1).alias("quire_kind"), "box_width", "pos", F.lit(None).cast("long").alias("quire_own"))
    found = last_known(ends.unionByName(asked), keys, ["quire_at", "quire_kind", "box_width", "pos"], "quire_own", "quire_next").filter("quire_kind = 1")
    return found.select(*keys, "box_width", "pos", F.greatest(F.coalesce("quire_next", F.lit(0)), F.col("pos") + 1).alias("next"))


#: Words of a block.
BLOCK = 1024
#: Blocks whose lines a task follows at once.
AT_ONCE = 256


def _block(pos: str):
    return F.col(pos) - F.col(pos) % BLOCK


def _in_blocks(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, box_width, block: its first word, nexts): of each word of a block in their order, the word that starts the next line."""
    dealt = steps.groupBy(*keys, "box_width", _block("pos").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "next"))).alias("of"))
    return dealt.select(*keys, "box_width", "block", F.col("of.next").alias("nexts"))


def followed(base: np.ndarray, ends: np.ndarray, nexts: np.ndarray, row: np.ndarray, pos: np.ndarray, most: np.ndarray):
    """Follows the lines from the words `pos` of the blocks `row`, until they leave the block or `most` are set: yields, line by line, (entry, start of the line, start of the next,
    whether it is the entry's last) of the entries that go on. Block i holds the words from base[i] on, and nexts up to ends[i] are its own."""
    entry = np.arange(len(pos))
    first = np.r_[0, ends[:-1]]
    at, done = pos - base[row], 0
    going = (at < ends[row] - first[row]) & (most > 0)  # there is no word at the end of the text
    while going.any():
        entry, row, at = entry[going], row[going], at[going]
        to = nexts[first[row] + at]
        done += 1
        then = to - base[row]
        going = (then < ends[row] - first[row]) & (done < most[entry])
        yield entry, at + base[row], to, ~going
        at = then


def _parts(batches):
    for batch in batches:
        for i in range(0, len(batch), AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def _entered(batch):
    """The blocks of a batch (.., block, nexts, entries) and their entries: (base, ends, nexts, row of each entry, entries)."""
    block, lists, entries = (batch.column(batch.schema.get_field_index(n)) for n in ("block", "nexts", "entries"))
    number = entries.value_lengths().to_numpy()
    return block.to_numpy(), lists.value_lengths().to_numpy().astype(np.int64).cumsum(), lists.flatten().to_numpy(), np.repeat(np.arange(len(number)), number), entries.flatten()


def _leave(batches):
    """Blocks with entries (words) in: (keys, box_width, pos: the entry, next: the first start of a line behind the block, lines: how many are set before it) out."""
    for batch in _parts(batches):
        *blocks, row, pos = _entered(batch)
        pos = pos.to_numpy()
        to, lines = np.full(len(pos), -1), np.zeros(len(pos), np.int64)
        for n, (entry, _, then, last) in enumerate(followed(*blocks, row, pos, np.full(len(pos), np.iinfo(np.int64).max)), 1):
            to[entry[last]], lines[entry[last]] = then[last], n
        some = np.flatnonzero(lines)
        names = [n for n in batch.schema.names if n not in ("block", "nexts", "entries")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).take(pa.array(row[some])) for n in names), *(pa.array(x[some]) for x in (pos, to, lines))], names=[*names, "pos", "next", "lines"])


def _lines(batches):
    """Blocks with entries (pos, quire_run, quire_line, quire_lines) in: their lines (keys, quire_run, quire_line, first, next, quire_lines) out, up to those of the stretch."""
    for batch in _parts(batches):
        *blocks, row, entries = _entered(batch)
        pos, run, line, most = (entries.field(n).to_numpy(zero_copy_only=False) for n in ("pos", "quire_run", "quire_line", "quire_lines"))
        found = [(entry, line[entry] + n, start, to) for n, (entry, start, to, _) in enumerate(followed(*blocks, row, pos, most - line))]
        if found:
            entry, nth, start, to = (np.concatenate(x) for x in zip(*found, strict=True))
            names = [n for n in batch.schema.names if n not in ("box_width", "block", "nexts", "entries")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).take(pa.array(row[entry])) for n in names), *(pa.array(x) for x in (run[entry], nth, start, to, most[entry]))], names=[*names, "quire_run", "quire_line", "first", "next", "quire_lines"])


def _with_entries(blocks: DataFrame, keys: list[str], entries: DataFrame, what) -> DataFrame:
    """The blocks that the entries (keys, box_width, pos, ..) lie in, with them as a list of `what`."""
    held = entries.groupBy(*keys, "box_width", _block("pos").alias("block")).agg(F.collect_list(what).alias("entries"))
    return blocks.join(held, [*keys, "box_width", "block"])


def _left(blocks: DataFrame, keys: list[str], entries: DataFrame) -> DataFrame:
    """(keys, box_width, pos, next, lines): where the lines from each of the entries (keys, box_width, pos) leave its block."""
    held = _with_entries(blocks, keys, entries, F.col("pos"))
    types = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in (*keys, "box_width"))
    return held.mapInArrow(_leave, f"{types}, pos long, next long, lines long")


def linked_boxes(words: DataFrame, boxes: DataFrame, keys: list[str], order: list[str], size: str, gap: int) -> DataFrame:
    """Words (keys, order, size) set greedily into lines and these into the boxes of their chain, (keys, box, box_width, lines), in the order of `box`: one row a line,
    (keys, box, line: from 0 in its box, first: number of its first word from 0, words: how many it holds).

    Between words of a line lies `gap`; sizes and widths are whole numbers, a null or negative size counts as 0. A word wider than its box has a line
    of its own. Boxes with a null width or without lines hold nothing, boxes behind the end of the text have no rows, and words behind the last line
    of a chain are in none. Keys and (keys, order) must not be null, and (keys, order) and (keys, box) not repeat. Rounds follow the number
    of stretches of boxes of one width, not that of boxes; a chain and a text may be of any length.
    """
    placed = cut(_numbered(words, keys, order, size, gap))
    chains = _chains(boxes, keys)
    runs = cut(chains.groupBy(*keys, "quire_run").agg(F.first("box_width").alias("box_width"), F.sum("lines").alias("quire_lines")))
    nexts = cut(_next(placed, runs.select(*keys, "box_width").distinct(), keys, gap))
    blocks = cut(_in_blocks(nexts, keys))
    # into a block lines lead from words of earlier ones; behind the last word there is no block or no word of it
    ahead = nexts.filter(_block("next") > _block("pos")).select(*keys, "box_width", F.col("next").alias("pos")).distinct()
    steps = [cut(_left(blocks, keys, ahead))]
    while not steps[-1].isEmpty():
        far = steps[-1].select(*keys, "box_width", F.col("pos").alias("next"), F.col("next").alias("quire_far"), F.col("lines").alias("quire_more"))
        steps.append(cut(steps[-1].join(far, [*keys, "box_width", "next"]).select(*keys, "box_width", "pos", F.col("quire_far").alias("next"), (F.col("lines") + F.col("quire_more")).alias("lines"))))
    entries, found, run = cut(placed.filter("pos = 0").select(*keys, "pos")), [], 1
    while not entries.isEmpty():
        state = [*keys, "box_width", "quire_run", "quire_lines", "quire_line", "pos"]
        start = cut(entries.join(runs.filter(F.col("quire_run") == run), keys).withColumn("quire_line", F.lit(0).cast("long")).select(*state))
        out = _left(blocks, keys, start.select(*keys, "box_width", "pos"))
        here = start.join(out, [*keys, "box_width", "pos"]).filter("lines <= quire_lines").select(*state[:-2], F.col("lines").alias("quire_line"), F.col("next").alias("pos"))
        for step in reversed(steps[:-1]):
            on = F.struct(F.col("quire_line").alias("l"), F.col("pos").alias("p"))
            off = F.struct((F.col("quire_line") + F.col("lines")).alias("l"), F.col("next").alias("p"))
            both = here.join(step, [*keys, "box_width", "pos"], "left").select(*state[:-2], F.explode(F.array(on, off)).alias("at"))
            # beyond the last word there is no row to join, and what lies beyond the line after the last is of no use
            here = both.filter("at.p IS NOT NULL AND at.l <= quire_lines").select(*state[:-2], F.col("at.l").alias("quire_line"), F.col("at.p").alias("pos"))
        here = start.unionByName(here)
        held = _with_entries(blocks, keys, here, F.struct("pos", "quire_run", "quire_line", "quire_lines"))
        types = ", ".join(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keys)
        set_ = cut(held.mapInArrow(_lines, f"{types}, quire_run long, quire_line long, first long, next long, quire_lines long"))
        found.append(set_.select(*keys, "quire_run", "quire_line", "first", (F.col("next") - F.col("first")).alias("words")))
        entries, run = set_.filter("quire_line + 1 = quire_lines").select(*keys, F.col("next").alias("pos")), run + 1
    if not found:
        return chains.filter("false").select(*keys, "box", F.col("lines").alias("line"), F.col("lines").alias("first"), F.col("lines").alias("words"))
    lines = found[0]
    for more in found[1:]:
        lines = lines.unionByName(more)
    # boxes and lines are sorted together, and each line takes the last box that began
    start = F.struct(F.col("box").alias("box"), F.col("quire_from").alias("at"))
    heads = chains.select(*keys, "quire_run", F.col("quire_from").alias("quire_line"), F.lit(0).alias("quire_kind"), start.alias("quire_box"))
    both = heads.unionByName(lines.withColumn("quire_kind", F.lit(1)), allowMissingColumns=True)
    held = last_known(both, [*keys, "quire_run"], ["quire_line", "quire_kind"], "quire_box", "quire_in").filter("quire_kind = 1")
    return held.select(*keys, F.col("quire_in.box").alias("box"), (F.col("quire_line") - F.col("quire_in.at")).alias("line"), "first", "words")
