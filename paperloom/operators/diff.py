"""SET-05, SRC-14: what changed between two versions of a file, line by line and in order.

Lines are rows (file, position, line). A file's two versions meet in one task, sorted, as a stream that holds one file.
There, lines that the other version lacks can match nothing, and equal starts and ends always belong to a longest common
subsequence; what is left is matched exactly. One row of the table of common lengths is an integer with a bit for each
line of the new version (a set bit: no longer common subsequence ends here), and a line of the old one advances it
by one sum, so 64 cells cost one machine operation. Where the rows together would be too many to keep, the old version
is halved, the best place to part the new one follows from the bits of both halves, and each part goes on by itself.

`anchored` first parts the files, for those that are too large for a task: lines that stand once in both versions meet
by a join; the longest run of these that ascends in both is kept (patience piles), and the stretches between them are
matched each by themselves, wherever Spark deals them. That script is in order and right, but may be longer than the
shortest.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequences import nth_free

#: Bits of rows that are kept at once: 32 MB.
KEPT_BITS = 1 << 28
OLD, NEW = 0, 1


def _masks(b: list[int]) -> dict[int, int]:
    """For each line the places where it stands, as bits."""
    out: dict[int, int] = {}
    for k, line in enumerate(b):
        out[line] = out.get(line, 0) | 1 << k
    return out


def _rows(a: list[int], b: list[int]):
    """The row of the table after each line of a."""
    full = (1 << len(b)) - 1
    masks, row = _masks(b), full
    for line in a:
        hit = row & masks.get(line, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(row: int, n: int) -> np.ndarray:
    """The common length with the first 0, 1, ... n lines of b, from the bits of a row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _matched(a: list[int], b: list[int], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Add the pairs (place in a + i, place in b + j) of a longest common subsequence, in order."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        out.append((i + start, j + start))
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    left, right = a[start : len(a) - end], b[start : len(b) - end]
    if left and right:
        if len(left) * len(right) <= KEPT_BITS or len(left) == 1:
            rows, x, y, pairs = list(_rows(left, right)), len(left), len(right), []
            while x and y:
                if rows[x - 1] >> y - 1 & 1:
                    y -= 1
                elif x > 1 and not rows[x - 2] >> y - 1 & 1:
                    x -= 1
                else:
                    x, y = x - 1, y - 1
                    pairs.append((i + start + x, j + start + y))
            out += reversed(pairs)
        else:
            half, n = len(left) // 2, len(right)
            above = below = (1 << n) - 1
            for above in _rows(left[:half], right):
                pass
            for below in _rows(left[half:][::-1], right[::-1]):
                pass
            cut = int((_lengths(above, n) + _lengths(below, n)[::-1]).argmax())
            _matched(left[:half], right[:cut], i + start, j + start, out)
            _matched(left[half:], right[cut:], i + start + half, j + start + cut, out)
    out += [(i + len(a) - end + k, j + len(b) - end + k) for k in range(end)]


def common_lines(old: list, new: list) -> list[tuple[int, int]]:
    """The places (in old, in new) of a longest common subsequence, in order."""
    both, number = set(old) & set(new), {}
    keep = [[k for k, line in enumerate(lines) if line in both] for lines in (old, new)]
    a, b = ([number.setdefault(lines[k], len(number)) for k in kept] for lines, kept in zip((old, new), keep, strict=True))
    out: list[tuple[int, int]] = []
    _matched(a, b, 0, 0, out)
    return [(keep[0][x], keep[1][y]) for x, y in out]


def _script(names: list[str]):
    """Rows come by file and stretch, the old version's before the new one's, each in order of place."""

    def flush(own: list, lines: list[list]) -> pa.RecordBatch:
        (old, new), out = lines, []
        x = y = 0
        for i, j in [*common_lines([t for _, t in old], [t for _, t in new]), (len(old), len(new))]:
            out += [("-", *old[k]) for k in range(x, i)]
            out += [("+", *new[k]) for k in range(y, j)]
            x, y = i + 1, j + 1
        sign, place, line = zip(*out, strict=True) if out else ((), (), ())
        repeated = [pa.array([v] * len(out), t) for v, t in own]
        return pa.RecordBatch.from_arrays([*repeated, pa.array(range(len(out)), pa.int64()), pa.array(sign, pa.string()), pa.array(place, pa.int64()), pa.array(line, pa.string())], names)

    def run(batches):
        last, own, lines = None, [], [[], []]
        for batch in batches:
            *keys, side, place, line = batch.columns
            types = [c.type for c in keys]
            for key, s, p, t in zip(zip(*(c.to_pylist() for c in keys), strict=True), side.to_pylist(), place.to_pylist(), line.to_pylist(), strict=True):
                if key != last:
                    if last is not None and lines != [[], []]:
                        yield flush(own, lines)
                    last, own, lines = key, [*zip(key, types, strict=True)], [[], []]
                lines[s].append((p, t))
        if last is not None:
            yield flush(own, lines)

    return run


def _piles(names: list[str]):
    """Of a file's anchors, in order of their old places, those of a longest run that ascends in the new ones too."""

    def longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        tops: list[int] = []
        of, before = [], []
        for k, (_, y) in enumerate(pairs):
            pile = bisect_left(tops, y)
            before.append(of[pile - 1] if pile else -1)
            tops[pile : pile + 1] = [y]
            of[pile : pile + 1] = [k]
        k, out = of[-1] if of else -1, []
        while k >= 0:
            out.append(pairs[k])
            k = before[k]
        return out[::-1]

    def run(batches):
        last, kind, pairs = None, None, []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last] * len(found := longest(pairs)), kind), pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names)
        for batch in batches:
            kind = batch.column(0).type
            for key, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pairs and key != last:
                    yield row()
                    pairs = []
                last = key
                pairs.append((x, y))
        if pairs:
            yield row()

    return run


def anchors(both: DataFrame, key: str) -> DataFrame:
    """(key, old place, new place) of lines that stand once in each version and ascend together."""
    once = lambda s: F.count_if(F.col("__side") == s) == 1
    place = lambda s: F.min(F.when(F.col("__side") == s, F.col("__place")))
    single = both.groupBy(key, "__line").agg(once(OLD).alias("a"), once(NEW).alias("b"), place(OLD).alias("old"), place(NEW).alias("new")).where("a and b").select(key, "old", "new")
    schema = T.StructType([single.schema[key], T.StructField("old", T.LongType()), T.StructField("new", T.LongType())])
    return single.repartition(key).sortWithinPartitions(key, "old").mapInArrow(_piles([key, "old", "new"]), schema)


def _beside(rows: DataFrame, marks: DataFrame, by: list[str], place: str, mark: str) -> DataFrame:
    """rows, clustered by the first of `by`, with __met, whether marks (by, place, mark) hold their place, and __passed, how many places to theirs do. A join would deal the texts out anew by place, and again for what follows."""
    w = Window.partitionBy(*by).orderBy(place, F.col(mark).desc_nulls_last())
    both = rows.withColumn(mark, F.lit(None).cast("int")).unionByName(marks.repartition(by[0]), allowMissingColumns=True)
    met = (F.lag(mark).over(w) == 1) & (F.lag(place).over(w) == F.col(place))
    both = both.withColumns({"__passed": F.count(mark).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__met": F.coalesce(met, F.lit(False))})
    return both.where(F.col(mark).isNull()).drop(mark)


def ordered_diff(old: DataFrame, new: DataFrame, key: str, place: str = "place", line: str = "line", anchored: bool = False) -> DataFrame:
    """(key, seq, sign, number, line): a shortest script of removed (-) and added (+) lines of each file, in order; number counts the lines of their own version from 1. Nulls are lines like any other. A file of one version alone is removed or added whole."""
    rows = lambda df, side: df.select(key, F.lit(side).alias("__side"), F.col(place).alias("__place"), F.col(line).alias("__line"))
    numbered = F.row_number().over(Window.partitionBy(key, "__side").orderBy("__place")).cast("long")
    both = rows(old, OLD).unionAll(rows(new, NEW)).repartition(key).withColumn("__place", numbered)
    by = [key]
    if anchored:
        found = anchors(both, key)
        marks = found.select(key, F.lit(OLD).alias("__side"), F.col("old").alias("__place")).unionAll(found.select(key, F.lit(NEW).alias("__side"), F.col("new").alias("__place"))).withColumn("__mark", F.lit(1))
        both = _beside(both, marks, [key, "__side"], "__place", "__mark").withColumn("__stretch", F.col("__passed")).where("not __met")
        by = [key, "__stretch"]
        both = both.repartition(*by)
    both = both.select(*by, "__side", "__place", "__line")
    schema = T.StructType([*both.select(*by).schema.fields, T.StructField("__at", T.LongType()), T.StructField("sign", T.StringType()), T.StructField("number", T.LongType()), T.StructField("line", T.StringType())])
    script = both.sortWithinPartitions(*by, "__side", "__place").mapInArrow(_script(schema.names), schema)
    seq = F.row_number().over(Window.partitionBy(key).orderBy(*by[1:], "__at"))
    return script.withColumn("seq", seq).select(key, "seq", "sign", "number", "line")


def patched(old: DataFrame, script: DataFrame, key: str, place: str = "place", line: str = "line") -> DataFrame:
    """(key, number, line): the new version. Added lines have their numbers there; those that stay take the free numbers in order."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(place)).cast("long")
    gone = script.where("sign = '-'").select(key, "number")
    own = old.repartition(key).select(key, number.alias("number"), F.col(line).alias("line"))
    kept = _beside(own, gone.withColumn("__mark", F.lit(1)), [key], "number", "__mark").where("not __met").drop("__passed", "__met")
    added = script.where("sign = '+'").select(key, "number", "line")
    ranked = kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("number")).cast("long").alias("__rank"), "line")
    return nth_free(ranked, added, [key], "__rank", "number").select(key, "number", "line").unionByName(added)


def diff_sizes(script: DataFrame, key: str) -> DataFrame:
    """Removed and added lines of each file that changed."""
    return script.groupBy(key).agg(F.count_if(F.col("sign") == "-").alias("removed"), F.count_if(F.col("sign") == "+").alias("added"))


def shown(script: DataFrame, key: str, most: int = 14) -> DataFrame:
    """The report of a file: its first lines with their signs, and how many more there are."""
    text = F.concat("sign", F.coalesce(F.substring("line", 1, 150), F.lit("")))
    return script.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("seq") <= most, F.struct("seq", text.alias("text"))))).alias("rows"), F.greatest(F.count("*") - most, F.lit(0)).alias("more")).select(key, F.transform("rows", lambda r: r["text"]).alias("lines"), "more")
