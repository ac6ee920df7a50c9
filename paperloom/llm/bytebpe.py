"""Byte-level BPE over whole Arrow columns.

Pre-tokens are found for a block of texts at once with array operations over UTF-8 bytes and looked up in an
open-addressed table of known pre-tokens, by their bytes. Only pre-tokens that the table lacks go through the
BPE merges. The rules are those of the byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

with the Unicode tables of the tokenizers library itself: code points on which Unicode versions differ are
looked up in that library. Texts that hold an added token's string go to the library as they are.

A hash only finds the place in the table. Two pre-tokens are equal if their bytes are: up to 16 bytes those are
the length, the first eight and the last eight; the bytes of longer ones are kept and compared.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer
from xxhash import xxh3_64_intdigest as xxh3

from .common import pieces

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of a span that its first and last eight bytes tell.
SHORT = 16
BLOCK = 1 << 20
#: Entries of a worker's cache; beyond it the cache starts anew.
CACHE = 1 << 19
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Spans:
    """Spans of raw as arrays: size, first and last eight bytes (of sizes to 8, first alone), and a 64-bit key that hangs on their bytes alone."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.raw, self.starts, self.ends = raw, starts, ends
        self.size = ends - starts
        padded = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
        at = np.ndarray((len(raw) + 9,), np.uint64, padded.data, 0, (1,))  # the eight bytes from each place less 8
        short = np.minimum(self.size, 8).astype(np.uint64) * np.uint64(8)
        self.first = at[starts + 8] & np.where(short >= 64, _ONES, (np.uint64(1) << (short & np.uint64(63))) - np.uint64(1))
        self.last = np.where(self.size > 8, at[ends], np.uint64(0))
        self.key = mixed(self.first ^ mixed(self.last + self.size.astype(np.uint64) * _MIX))
        self.long = np.flatnonzero(self.size > SHORT)
        if len(self.long):
            data = raw.tobytes()
            own = [xxh3(data[a:b]) for a, b in zip(starts[self.long].tolist(), ends[self.long].tolist(), strict=True)]
            self.key[self.long] ^= np.array(own, np.uint64)

    def __len__(self) -> int:
        return len(self.key)

    def take(self, rows: np.ndarray) -> Spans:
        """Some of the spans."""
        out = object.__new__(Spans)
        out.raw, out.starts, out.ends = self.raw, self.starts[rows], self.ends[rows]
        out.size, out.first, out.last, out.key = self.size[rows], self.first[rows], self.last[rows], self.key[rows]
        out.long = np.flatnonzero(out.size > SHORT)
        return out

    def words(self) -> list[bytes]:
        data = self.raw.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    @staticmethod
    def of(words: list[bytes]) -> Spans:
        ends = np.cumsum([0, *map(len, words)])
        return Spans(np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:])


_ONES = np.uint64((1 << 64) - 1)


@lru_cache(maxsize=2)
def _classes(path: str) -> np.ndarray:
    split = library(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    for c in np.flatnonzero((out == LETTER) | (out == NUMBER)).tolist():
        if unicodedata.category(ch := chr(c))[0] not in "LN":  # Unicode versions differ
            out[c] = LETTER if len(split("a" + ch)) == 1 else NUMBER if len(split("1" + ch)) == 1 else OTHER
    return out


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class ByteBpe:
    """A vocabulary file of a byte-level BPE and the split of texts into its pre-tokens."""

    def __init__(self, path: str) -> None:
        self.path = path
        raw = json.loads(library(path).to_str())
        codes = _printable()
        ranks = {bytes(codes[c] for c in token): i for token, i in raw["model"]["vocab"].items()}
        self.special = {x["content"].encode(): x["id"] for x in raw["added_tokens"]}
        self.merge = tiktoken.Encoding("byte_bpe", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = _classes(path)
        self.vocabulary = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in [*ranks.items(), *self.special.items()]:
            self.vocabulary[i] = token

    def split(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens of all texts, and the number of pre-tokens before each text (n + 1)."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.classes[:256][raw]
        high = np.flatnonzero(raw >= 0x80)
        lead = np.ones(n, bool)
        if len(high):
            self._wide(raw, high, kind, lead)
        first = np.zeros(n + 1, bool)  # of a text
        first[offsets[:-1]] = True
        first[n] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last white space before anything else stands alone, or belongs to it if it is a blank
        turn = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
        last = turn - 1
        for _ in range(3):
            last = np.where(lead[last], last, last - 1)
        blank = raw[turn - 1] == 0x20
        start[turn[blank]] = False
        start[last] = True
        quote = np.flatnonzero((raw == 0x27) & start)
        if len(quote):
            self._contractions(raw, quote, kind, start, first)
        starts = np.flatnonzero(start)
        return starts, np.searchsorted(starts, offsets)

    def _wide(self, raw: np.ndarray, high: np.ndarray, kind: np.ndarray, lead: np.ndarray) -> None:
        """Give every byte of a longer character its class."""
        value = raw[high]
        follows = (value & 0xC0) == 0x80
        lead[high[follows]] = False
        at, b0 = high[~follows], value[~follows].astype(np.uint32)
        size = np.where(b0 >= 0xF0, 4, np.where(b0 >= 0xE0, 3, 2))
        code = np.where(size == 4, b0 & 7, np.where(size == 3, b0 & 15, b0 & 31))
        end = len(raw) - 1
        for k in (1, 2, 3):
            more = size > k
            code[more] = (code[more] << np.uint32(6)) | (raw[np.minimum(at[more] + k, end)] & 63)
        found = self.classes[np.minimum(code, 0x10FFFF)]
        kind[at] = found
        for k in (1, 2, 3):
            more = size > k
            kind[at[more] + k] = found[more]

    @staticmethod
    def _contractions(raw: np.ndarray, quote: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
        n = len(raw)
        get = lambda at: np.where(at < n, raw[np.minimum(at, n - 1)], 0)
        inside = quote + 1 < n
        quote = quote[inside & ~first[np.minimum(quote + 1, n)]]
        one, two = get(quote + 1), np.where(first[np.minimum(quote + 2, n)], 0, get(quote + 2))
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, size in ((single, 1), (double & ~single, 2)):
            at = quote[found]
            start[at + 1] = False
            after = at + 1 + size
            after = after[after < n]
            start[after[kind[after] == LETTER]] = True

    def has_special(self, raw: np.ndarray) -> bool:
        data = raw.tobytes()
        return any(x in data for x in self.special)

    def encode_text(self, text: bytes) -> list[int]:
        return library(self.path).encode(text.decode(), add_special_tokens=False).ids


@lru_cache(maxsize=1)
def shared_bpe(path: str) -> ByteBpe:
    """One for all tasks of a worker: it holds no texts, and takes longer to set up than a small task."""
    return ByteBpe(path)


def _printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Keys:
    """Open-addressed 64-bit keys, each with the number of its entry."""

    def __init__(self, size: int) -> None:
        self.bits = max(10, int(size * 2).bit_length())
        self.limit = 1 << (self.bits - 1)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    def _probe(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        """From the addresses `at`, which move on: the next entry of each key, -1 where a free address comes first."""
        mask = (1 << self.bits) - 1
        out = self.slot[at]
        bad = np.flatnonzero((out >= 0) & (self.key[at] != key))
        while len(bad):
            at[bad] = (at[bad] + 1) & mask
            out[bad] = self.slot[at[bad]]
            bad = bad[(out[bad] >= 0) & (self.key[at[bad]] != key[bad])]
        return out

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        return self._probe(key, self._home(key))

    def place(self, key: np.ndarray) -> None:
        """New entries for keys, numbered on."""
        m, mask, at = len(key), (1 << self.bits) - 1, self._home(key)
        left, entry = np.arange(m), np.arange(self.n, self.n + m, dtype=np.int32)
        while len(left):
            free = left[self.slot[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slot[at[put]], self.key[at[put]] = entry[put], key[put]
            done = np.zeros(m, bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = np.where(self.slot[at[left]] >= 0, (at[left] + 1) & mask, at[left])
        self.n += m


class Table(Keys):
    """Pre-tokens by their bytes, open-addressed, with the ids of each in one pool."""

    def clear(self) -> None:
        super().clear()
        self.columns = {"size": np.zeros(1024, np.int32), "head": np.zeros(1024, np.uint64), "tail": np.zeros(1024, np.uint64), "body": np.zeros(1024, np.int64), "first": np.zeros(1024, np.int64), "count": np.zeros(1024, np.int32)}
        self.pool, self.used = np.zeros(4096, np.uint16), 0
        self.bytes, self.bytes_used = np.zeros(4096, np.uint8), 0

    first = property(lambda self: self.columns["first"])
    count = property(lambda self: self.columns["count"])

    def __getstate__(self) -> tuple:
        """Entries alone; the open addresses, several times their size, are made anew where it is unpacked."""
        key, n = np.empty(self.n, np.uint64), max(1, self.n)
        at = np.flatnonzero(self.slot >= 0)
        key[self.slot[at]] = self.key[at]
        narrow = lambda x: x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.int32)
        size, count = narrow(self.columns["size"][:n]), narrow(self.columns["count"][:n])
        return self.bits, self.limit, key, size, count, self.columns["head"][:n].copy(), self.columns["tail"][:n].copy(), self.pool[: self.used].copy(), self.bytes[: self.bytes_used].copy()

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.limit, key, size, count, head, tail, pool, body = state
        self.clear()
        self.place(key)
        before = lambda x: np.cumsum(x, dtype=np.int64) - x
        self.columns = {"size": size.astype(np.int32), "head": head, "tail": tail, "body": before(np.where(size > SHORT, size, 0).astype(np.int64)), "first": before(count.astype(np.int64)), "count": count.astype(np.int32)}
        self.pool, self.used, self.bytes, self.bytes_used = pool, len(pool), body, len(body)

    def find(self, spans: Spans) -> np.ndarray:
        """The entry of each span, -1 where there is none."""
        at = self._home(spans.key)
        out = self._probe(spans.key, at)
        wrong = self._differs(out, spans)
        while len(wrong):  # another pre-token has this key: go on behind it
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            part, place = spans.take(wrong), at[wrong]
            found = self._probe(part.key, place)
            at[wrong], out[wrong] = place, found
            wrong = wrong[self._differs(found, part)]
        return out

    def _differs(self, entry: np.ndarray, spans: Spans) -> np.ndarray:
        """Spans whose bytes are not those of the entry."""
        size, head, tail, body = (self.columns[k] for k in ("size", "head", "tail", "body"))
        bad = (entry >= 0) & ((size[entry] != spans.size) | (head[entry] != spans.first) | (tail[entry] != spans.last))
        long = spans.long[(entry[spans.long] >= 0) & ~bad[spans.long]]
        if len(long):
            n = spans.size[long]
            differ = self.bytes[pieces(body[entry[long]], n)] != spans.raw[pieces(spans.starts[long], n)]
            bad[long] = np.add.reduceat(differ, np.cumsum(n) - n) > 0
        return np.flatnonzero(bad)

    def add(self, spans: Spans, count: np.ndarray, ids: np.ndarray) -> None:
        """Add spans that are not in it yet, all different, with their ids one after the other."""
        n, m, total = self.n, len(spans), int(count.sum())
        own = np.where(spans.size > SHORT, spans.size, 0)
        values = {"size": spans.size, "head": spans.first, "tail": spans.last, "body": self.bytes_used + np.cumsum(own) - own, "first": self.used + np.cumsum(count) - count, "count": count}
        for name, value in values.items():
            self.columns[name] = _room(self.columns[name], n + m)
            self.columns[name][n : n + m] = value
        self.pool, self.bytes = _room(self.pool, self.used + total), _room(self.bytes, self.bytes_used + int(own.sum()))
        self.pool[self.used : self.used + total] = ids
        self.bytes[self.bytes_used : self.bytes_used + int(own.sum())] = spans.raw[pieces(spans.starts, own)]
        self.used, self.bytes_used = self.used + total, self.bytes_used + int(own.sum())
        self.place(spans.key)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values at least."""
    return x if len(x) >= n else np.resize(x, max(1024, 1 << int(n - 1).bit_length()))


class Encoder:
    """Encodes blocks of texts; remembers pre-tokens, up to CACHE new ones besides those it was given."""

    def __init__(self, path: str, known: Table | None = None, cache: int = CACHE) -> None:
        self.bpe, self.known, self.cache = shared_bpe(path), known, Table(cache)

    def blocks(self, raw: np.ndarray, offsets: np.ndarray):
        """(first text, end, bytes, offsets) of runs of texts of about BLOCK bytes."""
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
            b = min(b, n)
            yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b

    def lookup(self, raw: np.ndarray, offsets: np.ndarray):
        """(entry, keys, pre-tokens before each text) of a block without added tokens; entries from -2 down are the cache's."""
        starts, before = self.bpe.split(raw, offsets)
        spans = Spans(raw, starts, np.append(starts[1:], len(raw)))
        entry = np.full(len(starts), -1, np.int32)
        if self.known is not None:
            entry = self.known.find(spans)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            if self.cache.n + len(miss) > self.cache.limit:
                self.cache.clear()
                if len(miss) > self.cache.limit:
                    self.cache = Table(len(miss))
            asked = spans.take(miss)
            found = self.cache.find(asked)
            while len(new := np.flatnonzero(found < 0)):  # words that share a key are learned one by one
                self._learn(asked.take(new))
                found[new] = self.cache.find(asked.take(new))
            entry[miss] = -2 - found
        return entry, spans.key, before

    def _learn(self, spans: Spans) -> None:
        _, one = np.unique(spans.key, return_index=True)
        spans = spans.take(one)
        ids = [self.bpe.merge(x) for x in spans.words()]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        self.cache.add(spans, count, np.fromiter(chain.from_iterable(ids), np.uint16, int(count.sum())))

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b, part, at in self.blocks(raw, offsets):
            if self.bpe.has_special(part):
                out[a:b] = [self._count_one(part[at[k] : at[k + 1]]) for k in range(b - a)]
                continue
            if len(cuts := self._cuts(part)) > 2:
                out[a] = sum(int(self._sizes(self.lookup(part[x:y], np.array([0, y - x]))[0]).sum()) for x, y in zip(cuts, cuts[1:], strict=False))
                continue
            entry, _, before = self.lookup(part, at)
            out[a:b] = self._sums(self._sizes(entry), before)
        return out

    @staticmethod
    def _cuts(part: np.ndarray) -> list[int]:
        """Bounds of parts of about 4 BLOCK bytes of a long text, before blanks between two letters, where a pre-token always begins."""
        cuts, step = [0], 4 * BLOCK
        while len(part) - cuts[-1] > 2 * step:
            near = part[cuts[-1] + step : cuts[-1] + 2 * step]
            letter = ((near | 32) >= 97) & ((near | 32) <= 122)
            found = np.flatnonzero((near[1:-1] == 0x20) & letter[:-2] & letter[2:])
            cuts.append(cuts[-1] + step + 1 + int(found[0]) if len(found) else len(part))
        return cuts if cuts[-1] == len(part) else [*cuts, len(part)]

    def _count_one(self, part: np.ndarray) -> int:
        if self.bpe.has_special(part):
            return len(self.bpe.encode_text(part.tobytes()))
        entry, _, _ = self.lookup(part, np.array([0, len(part)]))
        return int(self._sizes(entry).sum())

    def _sizes(self, entry: np.ndarray) -> np.ndarray:
        own = entry < -1
        size = self.cache.count[np.where(own, -2 - entry, 0)]
        return size if self.known is None else np.where(own, size, self.known.count[np.where(own, 0, entry)])

    @staticmethod
    def _sums(size: np.ndarray, before: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return np.diff(total[before])

    def ids(self, raw: np.ndarray, offsets: np.ndarray):
        """For each block: (first text, end, ids of all its texts, ids before each text)."""
        for a, b, ids, before, _, _ in self.ids_and_keys(raw, offsets):
            yield a, b, ids, before

    def ids_and_keys(self, raw: np.ndarray, offsets: np.ndarray):
        """For each block: (first text, end, ids of all its texts, ids before each text, keys of their pre-tokens, pre-tokens before each text)."""
        for a, b, part, at in self.blocks(raw, offsets):
            if self.bpe.has_special(part):
                each = [self._ids_one(part[at[k] : at[k + 1]]) for k in range(b - a)]
                yield a, b, np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])]), *self.keys(part, at)
            elif len(cuts := self._cuts(part)) > 2:
                each = [self._ids_block(part[x:y], np.array([0, y - x])) for x, y in zip(cuts, cuts[1:], strict=False)]
                ids, keys = np.concatenate([x[0] for x in each]), np.concatenate([x[2] for x in each])
                yield a, b, ids, np.array([0, len(ids)]), keys, np.array([0, len(keys)])
            else:
                yield a, b, *self._ids_block(part, at)

    def keys(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a block's pre-tokens, and how many stand before each text."""
        starts, before = self.bpe.split(part, at)
        return Spans(part, starts, np.append(starts[1:], len(part))).key, before

    def _ids_one(self, part: np.ndarray) -> np.ndarray:
        if self.bpe.has_special(part):
            return np.array(self.bpe.encode_text(part.tobytes()), np.uint16)
        return self._ids_block(part, np.array([0, len(part)]))[0]

    def _ids_block(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        entry, keys, before = self.lookup(part, at)
        own, size = entry < -1, self._sizes(entry).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(total[-1]), np.uint16)
        for table, rows in ((self.cache, np.flatnonzero(own)), (self.known, np.flatnonzero(~own))):
            if len(rows):
                if len(rows) == len(entry):
                    out = table.pool[pieces(table.first[np.where(own, -2 - entry, entry)], size)]
                else:
                    out[pieces(total[rows], size[rows])] = table.pool[pieces(table.first[np.where(own, -2 - entry, entry)[rows]], size[rows])]
        return out, total[before], keys, before
