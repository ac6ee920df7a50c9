"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or
another. Strings are judged on the input, and matches never cross documents.

Candidates. Every window of LENGTH bytes has an anchor: of the hashes of the GRAM-byte strings within it,
the place of the least, leftmost first. The choice hangs on the window's bytes alone, so equal windows have
equal anchors at the same distance. Windows with the same anchor are consecutive; together they make the
anchor's stretch, so all windows of a text need one row for about 75 bytes: hash of the anchor's string,
128-bit digest of the stretch. Rows meet by the first. Rows of equal digest stand for one stretch, whose windows
all repeat in each of them; one of them speaks for it. A row alone has none. Where one anchor string has several
stretches (at the edges of repeated passages), the bytes of one row for each meet and are sorted.

Sort. In such a group the suffixes from the anchor on are put in order by mergesort, and so are the prefixes
before the anchor, read backwards. Two are compared by their longest common extension, found by binary
search over prefix polynomial hashes, and the byte after it. Neighbours' common extensions are then compared
byte by byte; if a hash ever collided, the group is sorted by its bytes instead. For each distance d of a
window's start before the anchor, windows are equal if no break under LENGTH - d parts them in the one order
and none under d in the other, so classes come from two running counts, without pairs.

A group of over `most` stretches is split before it is gathered. A window that starts x to y bytes before the anchor
holds all bytes from x before it to LENGTH - y after it, so equal windows agree there: the range of distances is
halved, each half of a stretch becomes a stretch of its own, and the longer string that its windows share is the new
anchor string. What is one string in the whole group falls together as one stretch; the rest parts. At a range of one
distance the string is the window itself, and a group has one stretch.

Defined cases: null text counts as empty; texts under LENGTH bytes lose nothing; very long texts are taken in parts
and held whole only where they are cut; repeated rows (with or without doc_id) repeat each other and share one list of
spans; tables without repeats and empty tables give empty spans and results; columns beyond doc_id and text pass through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import mixed
from .common import column_bytes, cut_lineage, lean, pieces, small_batches, text_or_empty

LENGTH, GRAM = 200, 48
SPREAD = LENGTH - GRAM + 1
#: Stretches of one anchor string that one task may hold.
GROUP = 20_000
#: Bytes of texts that are taken at once; their arrays are some hundred times as large.
BLOCK = 1 << 19
#: Bytes of stretches in one batch.
BODIES = 64 << 20
#: Kinds of rows: to be judged, alone in its batch or not; and judged.
ONE, MANY, SAME, OPEN, SPEAKER = -1, -2, 0, 1, 2


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(n + 1, _P, np.uint64), np.full(n + 1, _P_INV, np.uint64)
    for x in out:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    return _powers(1 << max(20, int(n).bit_length()))


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 128-bit XXH3 of each span, as rows of two signed numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def stretches(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, hash of the anchor's string) for all windows of all texts."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none, none.view(np.uint64)
    power, inverse = powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=total[1:])
    grams = len(raw) - GRAM + 1
    gram = mixed((total[GRAM:] - total[:grams]) * inverse[:grams])
    bits = np.uint64(max(1, int(grams).bit_length()))
    least = ((gram >> bits) << bits) | np.arange(grams, dtype=np.uint64)
    size = 1
    while size * 2 <= SPREAD:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(least) - (SPREAD - size)], least[SPREAD - size :])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    long = np.flatnonzero(np.diff(at) >= LENGTH)
    count = np.diff(at)[long] - LENGTH + 1
    window = pieces(at[long], count)
    text = np.repeat(long, count)
    own = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(own) else none
    last = np.append(first[1:], len(own)) - 1 if len(own) else none
    a, low, high = own[first], window[first], window[last]
    return text[first], a, low, high, gram[a]


def _blocks(at: np.ndarray):
    """(first text, end, first byte, offsets) of runs of texts of about BLOCK bytes; a longer text comes in parts that overlap by a window less one, so each window lies in one."""
    a, n = 0, len(at) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1))
        if b == a + 1 and at[b] - at[a] > 2 * BLOCK:
            for start in range(int(at[a]), int(at[b]) - LENGTH + 1, BLOCK):
                yield a, b, start, np.array([0, min(BLOCK + LENGTH - 1, int(at[b]) - start)])
        else:
            yield a, b, int(at[a]), at[a : b + 1] - at[a]
        a = b


ROWS = ["gram", "stretch", "stretch2", "k1", "k2", "place", "reach", "kind"]
SCHEMA = ", ".join(f"{c} {'int' if c in ('reach', 'kind') else 'long'}" for c in ROWS)


def _rows(parts: list):
    """A batch of rows from arrays (gram, digests, k1, k2, place, reach). Of rows that are equal within it one goes on as MANY to be judged, and the others are SAME at once, so a passage that half of all texts hold brings one row a batch."""
    gram, digest, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((digest[:, 1], digest[:, 0], gram))
    g, s = gram[order], digest[order]
    again = np.concatenate([[False], (g[1:] == g[:-1]) & (s[1:] == s[:-1]).all(axis=1)])[: len(g)]
    kind = np.where(again, SAME, np.where(np.append(again[1:], False)[: len(g)], MANY, ONE))
    k1, k2, place, reach = (x[order] for x in rest)
    return pa.RecordBatch.from_arrays([*map(pa.array, (g, s[:, 0].copy(), s[:, 1].copy(), k1, k2, place)), pa.array(reach.astype(np.int32)), pa.array(kind.astype(np.int32))], ROWS)


def _anchors(batches):
    """A row for each stretch."""
    for batch in batches:
        k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        raw, at = column_bytes(batch.column(2))
        parts = []
        for a, b, start, own in _blocks(at):
            part = raw[start : start + own[-1]]
            text, anchor, low, high, gram = stretches(part, own)
            place = ((low - own[text] + (start - at[a])) << 16) | ((anchor - low) << 8) | (high - low)
            parts.append((gram.view(np.int64), digests(part.tobytes(), low, high + LENGTH), k1[a:b][text], k2[a:b][text], place, np.full(len(place), SPREAD - 1)))
        if parts:
            yield _rows(parts)


def _halves(batches):
    """Stretches of groups to be split, as the stretches of both halves of the group's range of distances (reach: its least and greatest)."""
    for batch in batches:
        gram, k1, k2, place, reach = (np.asarray(batch.column(c)) for c in range(5))
        raw, at = column_bytes(batch.column(5))
        low, before, more = _unpack(place)
        data, parts = raw.tobytes(), []
        least, most = reach >> 8, reach & 0xFF
        middle = (least + most) >> 1
        for x, y in ((least, middle), (middle + 1, most)):
            near, far = np.maximum(x, before - more), np.minimum(y, before)
            row = np.flatnonzero((near <= far) & (x <= y))
            x, y, near, far = x[row], y[row], near[row], far[row]
            anchor = at[:-1][row] + before[row]
            shared = digests(data, anchor - x, anchor + LENGTH - y)
            key = mixed((shared[:, 0] ^ gram[row] ^ (x << 8 | y)).view(np.uint64)).view(np.int64)
            own = digests(data, anchor - far, anchor - near + LENGTH)
            parts.append((key, own, k1[row], k2[row], ((low[row] + before[row] - far) << 16) | (far << 8) | (far - near), x << 8 | y))
        yield _rows(parts)


def _judged(batches):
    """Rows sorted by gram and digest: SAME for all whose stretch repeats; where a gram has several stretches, also the first row of each, as SPEAKER if the stretch repeats and else as OPEN. The state is one row ahead, and the first row of a gram that waits for another stretch."""
    held, before, wait = None, None, None
    for batch in _and_end(batches):
        if batch is None and held is None:
            return
        columns = [np.asarray(c) for c in batch.columns] if batch is not None else [x[:0] for x in held]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        rows = len(columns[0]) - (batch is not None)
        if rows < 0:
            continue
        held = [c[rows:] for c in columns]
        gram, one, two, *rest, own = columns
        if not rows:
            continue
        same_gram = np.concatenate([[before is not None and before[0] == gram[0]], gram[1:] == gram[:-1]])
        goes_on = same_gram & np.concatenate([[before is not None and before[1:] == (one[0], two[0])], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
        repeats = (goes_on | np.append(goes_on[1:], False) | (own == MANY))[:rows]
        head = np.flatnonzero(~goes_on[:rows])
        first = ~same_gram[head]
        followed = np.append(~first[1:], False) & first if len(head) else first
        speak = head[~first | followed]
        same = np.flatnonzero(repeats)
        row = np.concatenate([same, speak])
        kind = np.concatenate([np.full(len(same), SAME), np.where(repeats[speak], SPEAKER, OPEN)])
        out = [gram[row], *(x[row] for x in rest), kind.astype(np.int32)]
        if len(head):
            if not first[0] and wait is not None:
                out = [np.append(x, np.array(y, x.dtype)) for x, y in zip(out, wait, strict=True)]
            top = head[-1]
            wait = (gram[top], *(x[top] for x in rest), SPEAKER if repeats[top] else OPEN) if first[-1] else None
        before = (gram[rows - 1], one[rows - 1], two[rows - 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], JUDGED)


JUDGED = ["gram", "k1", "k2", "place", "reach", "kind"]


def _and_end(batches):
    yield from batches
    yield None


class Suffixes:
    """Suffixes of byte strings, sorted by group and then by content through prefix polynomial hashes."""

    def __init__(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> None:
        self.raw, self.start, self.size, self.group = raw, start, size, group
        power, self.inverse = powers(len(raw))
        self.total = np.empty(len(raw) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(_BYTES[raw] * power[: len(raw)], out=self.total[1:])
        self.order = self._mergesort()
        self.common = self._verified()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, by binary search over hashes."""
        a, b = self.start[i], self.start[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        shift_a, shift_b, base_a, base_b = self.inverse[a], self.inverse[b], self.total[a], self.total[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) >> 1
            equal = (self.total[a + middle] - base_a) * shift_a == (self.total[b + middle] - base_b) * shift_b
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix i stands before j; ties for equal ones."""
        g = self.group[i] - self.group[j]
        out = g < 0
        own = np.flatnonzero(g == 0)
        if len(own):
            a, b = i[own], j[own]
            n = self.extension(a, b)
            end_a, end_b = n == self.size[a], n == self.size[b]
            top = len(self.raw) - 1
            x = np.where(end_a, -1, self.raw[np.minimum(self.start[a] + n, top)].astype(np.int64))
            y = np.where(end_b, -1, self.raw[np.minimum(self.start[b] + n, top)].astype(np.int64))
            out[own] = (x < y) | (ties & (x == y))
        return out

    def _mergesort(self) -> np.ndarray:
        """Bottom-up: each element's place among the other run is found by binary search, for all runs at once."""
        n = len(self.start)
        order, width = np.arange(n), 1
        while width < n:
            place = np.arange(n)
            run = place // width
            right = (run & 1) == 1
            other = np.where(right, run - 1, run + 1) * width
            low, high = np.minimum(other, n), np.minimum(other + width, n)
            first = low.copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                before = np.empty(len(open_), bool)
                for side in (False, True):  # equal ones of the left run come first
                    at = np.flatnonzero(right[open_] == side)
                    before[at] = self.less(order[middle[at]], order[open_[at]], side)
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            merged = np.empty(n, np.int64)
            merged[(run - right) * width + (place - run * width) + (low - first)] = order
            order, width = merged, width * 2
        return order

    def _verified(self) -> np.ndarray:
        """Common prefixes of neighbours (-1 between groups), compared byte by byte; collided orders are made anew from the bytes."""
        common = self._neighbours()
        i, j = self.order[:-1], self.order[1:]
        n = np.maximum(common[1:], 0)
        if (self.raw[pieces(self.start[i], n)] == self.raw[pieces(self.start[j], n)]).all():
            return common
        data = self.raw.tobytes()
        text = [data[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(text)), key=lambda k: (self.group[k], text[k])), np.int64)
        exact = [-1]
        for a, b in zip(self.order[:-1], self.order[1:], strict=True):
            same = self.group[a] == self.group[b]
            x, y = text[a], text[b]
            exact.append(next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) if same else -1)
        return np.array(exact, np.int64)

    def _neighbours(self) -> np.ndarray:
        out = np.full(len(self.order), -1, np.int64)
        i, j = self.order[:-1], self.order[1:]
        same = np.flatnonzero(self.group[i] == self.group[j])
        out[same + 1] = self.extension(i[same], j[same])
        return out


def repeated_windows(raw: np.ndarray, at: np.ndarray, group: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For stretches raw[at[i]:at[i+1]] of groups in order, anchors `before` bytes in and more + 1 windows: which window starts repeat, as a mask over distance from the anchor."""
    start = at[:-1] + before
    right = Suffixes(raw, start, at[1:] - start, group)
    left = Suffixes(raw[::-1].copy(), len(raw) - start, before, group)
    n = len(start)
    out = np.zeros((n, SPREAD), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(SPREAD):
        active = np.flatnonzero((before - more <= d) & (d <= before))
        if len(active) < 2:
            continue
        class_r[right.order] = np.cumsum(right.common < LENGTH - d)
        class_l[left.order] = np.cumsum(left.common < d)
        _, which, count = np.unique(class_r[active] * (n + 1) + class_l[active], return_inverse=True, return_counts=True)
        out[active, d] = count[which] > 1
    return out


def _spans(mask: np.ndarray, before: np.ndarray, low: np.ndarray):
    """(row, first window, last window) of the runs of a mask over distances."""
    ahead = mask[:, ::-1]  # by window start, ascending
    edge = np.diff(np.pad(ahead, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    shift = low[row] + before[row] - (SPREAD - 1)
    return row, shift + first, shift + end - 1


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 0xFF, place & 0xFF


RANGE = "k1 long, k2 long, low long, high long"


def _ranges(k1, k2, low, high):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (k1, k2, low, high)], ["k1", "k2", "low", "high"])


def _sorted_groups(batches):
    """Stretches sorted by gram: whole groups are resolved, some thousand stretches at once."""
    held: list[pa.RecordBatch] = []
    count = 0

    def resolve(table: pa.Table):
        if len(table) < 2:
            return None
        gram, k1, k2, place = (np.asarray(table.column(c)) for c in range(4))
        raw, at = column_bytes(table.column(5))
        low, before, more = _unpack(place)
        mask = repeated_windows(raw, at, np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]])), before, more)
        row, first, last = _spans(mask, before, low)
        return _ranges(k1[row], k2[row], first, last)

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < 4096 or held[0].column(0)[0].as_py() == batch.column(0)[-1].as_py():
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        gram = np.asarray(table.column(0))
        cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
        if (out := resolve(table.slice(0, cut).combine_chunks())) is not None:
            yield out
        rest = table.slice(cut).combine_chunks()
        held, count = rest.to_batches(), len(rest)
    if held and (out := resolve(pa.Table.from_batches(held).combine_chunks())) is not None:
        yield out


def _cut_out(batches):
    """From documents with lists of stretches' places: the stretches' bytes. The join brings equal rows one after the other; one of them is enough."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        batch = batch.filter(pa.array([x != y for x, y in zip(keys, [last, *keys], strict=False)], pa.bool_()))
        last = keys[-1] if keys else last
        raw, at = column_bytes(batch.column(3))
        lists = batch.column(4)
        ends = lists.offsets.to_numpy()
        flat = lists.values.slice(ends[0], ends[-1] - ends[0])
        gram, place, reach = (np.asarray(flat.field(c)) for c in ("gram", "place", "reach"))
        doc = np.repeat(np.arange(len(batch)), np.diff(ends))
        low, _, more = _unpack(place)
        end = np.cumsum(more + LENGTH)
        a = 0
        while a < len(place):
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + BODIES, "right")))
            rows = slice(a, b)
            count = more[rows] + LENGTH
            data = raw[pieces(at[:-1][doc[rows]] + low[rows], count)]
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            k1, k2 = (np.asarray(batch.column(c))[doc[rows]] for c in (1, 2))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (gram[rows], k1, k2, place[rows], reach[rows])), body], ["gram", "k1", "k2", "place", "reach", "body"])
            a = b


def _removed(as_text: bool):
    def run(batches):
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            lists = batch.column(2).to_pylist()
            removed, spans, kept = [], [], []
            for i, ranges in enumerate(lists):
                text = raw[at[i] : at[i + 1]]
                if not ranges:
                    removed.append(0), spans.append(0), kept.append(text.tobytes())
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                low, high = np.array([x["low"] for x in ranges]), np.array([x["high"] for x in ranges]) + LENGTH
                np.add.at(step, low, 1)
                np.add.at(step, high, -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, most: int = GROUP, as_text: bool = False) -> DataFrame:
    """docs without text, with n_bytes, n_removed, n_spans and kept: the remaining bytes, or as text without the parts of characters that a cut leaves."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept")]
    text = text_or_empty()
    key = F.col("doc_id").cast("string")
    row = F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(names)))  # other columns ride along under names of our own
    keyed = docs.select(row.alias("row"), F.xxhash64(key, text).alias("k1"), F.xxhash64(F.lit(7), text, key).alias("k2"), text.alias("text"))
    asked = keyed.select("k1", "k2", "text").mapInArrow(lean(_anchors), SCHEMA)
    same, settled = [], []
    low, more = F.shiftright("place", 16), F.col("place").bitwiseAND(0xFF)

    def bodies(rows: DataFrame) -> DataFrame:
        """The bytes of rows' stretches."""
        wanted = rows.groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "place", "reach")).alias("places"))
        # all columns, so that this exchange of the texts serves the last join as well
        return keyed.join(wanted.hint("shuffle_merge"), ["k1", "k2"]).select("row", "k1", "k2", "text", "places").mapInArrow(lean(_cut_out), "gram long, k1 long, k2 long, place long, reach int, body binary")

    while True:
        with small_batches(spark):
            asked = cut_lineage(asked)
        with small_batches(spark, 20_000):
            met = asked.where(F.col("kind") < SAME).repartition("gram").sortWithinPartitions("gram", "stretch", "stretch2")
            judged = cut_lineage(met.mapInArrow(lean(_judged), ", ".join(f"{c} {'int' if c in ('reach', 'kind') else 'long'}" for c in JUDGED)))
        same += [x.where(F.col("kind") == SAME).select("k1", "k2", low.alias("low"), (low + more).alias("high")) for x in (asked, judged)]
        open_ = judged.where(F.col("kind") != SAME).select(*JUDGED[:-1])
        hot = cut_lineage(open_.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most).select("gram"))
        if hot.isEmpty():
            settled.append(open_)
            break
        settled.append(open_.join(hot, "gram", "left_anti"))
        asked = bodies(open_.join(hot, "gram", "left_semi")).mapInArrow(lean(_halves), SCHEMA)
    open_ = settled[0]
    for x in settled[1:]:
        open_ = open_.unionByName(x)
    ranges = bodies(open_).repartition("gram").sortWithinPartitions("gram", "k1", "k2", "place").mapInArrow(lean(_sorted_groups), RANGE)
    for x in same:
        ranges = ranges.unionByName(x)
    found = ranges.groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = keyed.join(found.hint("shuffle_merge"), ["k1", "k2"], "left").select("row", "text", "ranges")
    kinds = [("row", keyed.schema["row"].dataType), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.StringType() if as_text else T.BinaryType())]
    out = joined.mapInArrow(lean(_removed(as_text)), T.StructType([T.StructField(name, kind) for name, kind in kinds]))
    return out.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)), "n_bytes", "n_removed", "n_spans", "kept")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: In hexadecimal, as SQL has no windows over bytes: two digits a byte.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, s, md5(substr(h, 2 * s + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS s FROM d)),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT rid, s, sum(st) OVER (PARTITION BY rid ORDER BY s) AS g FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 0 ELSE 1 END AS st FROM r)),
run AS (SELECT rid, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY rid, g),
gap AS (SELECT rid, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS x, a AS y FROM run UNION ALL SELECT rid, max(b), 1000000000000 FROM run GROUP BY rid),
kept AS (SELECT gap.rid, string_agg(substr(h, 2 * x + 1, 2 * (least(y, length(h) // 2) - x)), '' ORDER BY x) AS h FROM gap JOIN d ON d.rid = gap.rid GROUP BY gap.rid),
cut AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY rid)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN cut ON cut.rid = d.rid LEFT JOIN kept ON kept.rid = d.rid
"""
