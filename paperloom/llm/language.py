"""Language identification by a byte convolutional network.

Texts are cut into windows of WINDOW bytes that look AHEAD bytes on, so every run of up to AHEAD + 1 bytes stands in one
window. Bytes become symbols: letters without case, digits, white space, marks, every byte beyond ASCII. Filters of two,
three and four symbols slide over a window, the greatest answer of each filter is kept, and a softmax over these gives
the window's languages. The network is trained in numpy on a bounded sample: at most SAMPLE windows, as many of each of
the LANGUAGES most frequent languages, drawn by hash and cut in tasks. For prediction the filters are laid out as two
tables over pairs of symbols, so a position costs two lookups. A text's languages are the mean of its windows' by
their letters; score is that of the best one.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned;
a short text is a padded window; a very long one is taken window by window, whole; equal texts get equal results; ties
go to the language first by name; rows without doc_id count as id '' in the split; documents with null language or text
teach nothing; an empty table gives an empty result; further columns pass through, and those named like a result are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import mixed
from .common import column_bytes, cut_lineage, small_batches, text_or_empty

#: Windows learned from at most, languages, and windows of one text where there are few texts.
SAMPLE, LANGUAGES, PER_TEXT = 8_000, 200, 8
WINDOW, AHEAD = 128, 3
WIDTHS, FILTERS = (2, 3, 4), 16
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.01, 11
#: Windows that are taken at once.
STEP = 256
PAD, SPACE, DIGIT, MARK, LETTER, HIGH = 0, 1, 2, 3, 4, 30
SYMBOLS = HIGH + 128
RESULTS = ("lang_pred", "score")


def _symbols() -> np.ndarray:
    of = np.full(256, MARK, np.uint8)
    of[:33] = SPACE
    of[48:58] = DIGIT
    of[65:91] = of[97:123] = np.arange(LETTER, LETTER + 26)
    of[128:] = np.arange(HIGH, SYMBOLS)
    return of


SYMBOL = _symbols()


def windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbols of a window and what it looks ahead to, from each start; PAD from the end of its text on."""
    at = starts[:, None] + np.arange(WINDOW + AHEAD)
    inside = at < ends[:, None]
    return np.where(inside, SYMBOL[raw[np.where(inside, at, 0)]] if len(raw) else PAD, PAD)


class Network:
    """Filters as one table of symbols for each offset (columns: all filters of all widths), and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.languages = languages
        self.reach = np.repeat(WIDTHS, FILTERS)
        inside = np.arange(max(WIDTHS))[:, None] < self.reach
        self.filters = (rng.normal(0, 0.3, (max(WIDTHS), SYMBOLS, n)) * inside[:, None, :]).astype(np.float32)
        self.inside = inside[:, None, :]
        self.layer = rng.normal(0, 0.3, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self._pairs = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": None}

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.layer + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        logits = np.exp(logits)
        return logits / logits.sum(axis=1, keepdims=True)

    def fit(self, symbols: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the cross entropy; half of the windows are cut short each time, so that short texts are known too."""
        rng = np.random.default_rng(seed)
        params = [self.filters, self.layer, self.bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(symbols))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                length = np.where(rng.random(len(rows)) < 0.5, WINDOW + AHEAD, rng.integers(4, WINDOW, len(rows)))
                x = np.where(np.arange(WINDOW + AHEAD) < length[:, None], symbols[rows], PAD).astype(np.intp)
                for k, grad in enumerate(self._gradients(x, labels[rows])):
                    if not k:
                        t += 1
                    first[k] += 0.1 * (grad - first[k])
                    second[k] += 0.001 * (grad * grad - second[k])
                    params[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        self._pairs = None

    def _gradients(self, x: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        answers = sum(self.filters[o][x[:, o : o + WINDOW]] for o in range(max(WIDTHS)))
        place = answers.argmax(axis=1)
        top = np.take_along_axis(answers, place[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        delta = self.softmax(pooled)
        delta[np.arange(len(x)), label] -= 1
        delta /= len(x)
        back = (delta @ self.layer.T) * (top > 0)
        n = back.shape[1]
        filters = np.stack([np.bincount((np.take_along_axis(x, place + o, 1) * n + np.arange(n)).ravel(), back.ravel(), SYMBOLS * n).reshape(SYMBOLS, n) for o in range(max(WIDTHS))])
        return [(filters * self.inside).astype(np.float32), pooled.T @ delta, delta.sum(axis=0)]

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Answers of a pair of symbols at offsets 0 and 1, and at offsets 2 and 3 of the wider filters."""
        if self._pairs is None:
            f = self.filters
            self._pairs = tuple(np.ascontiguousarray((f[o][:, None] + f[o + 1][None, :]).reshape(SYMBOLS * SYMBOLS, -1)[:, skip:]) for o, skip in ((0, 0), (2, FILTERS)))
        return self._pairs

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        first, second = self._tables()
        wide = symbols.astype(np.intp)
        pair = wide[:, :-1] * SYMBOLS + wide[:, 1:]
        answers = first[pair[:, :WINDOW]]
        answers[:, :, FILTERS:] += second[pair[:, 2:]]
        return self.softmax(np.maximum(answers.max(axis=1), 0))

    def texts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The languages' shares of each text, over all of its windows."""
        count = np.maximum(1, -(-np.diff(at) // WINDOW))
        text = np.repeat(np.arange(len(count)), count)
        start = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        total, weight = np.zeros((len(count), len(self.languages))), np.zeros(len(count))
        for k in range(0, len(text), STEP):
            own = text[k : k + STEP]
            symbols = windows(raw, start[k : k + STEP], at[own + 1])
            letters = (symbols[:, :WINDOW] >= LETTER).sum(axis=1) + 1e-3
            np.add.at(total, own, self.probabilities(symbols) * letters[:, None])
            np.add.at(weight, own, letters)
        return total / weight[:, None]


def remainder(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4


def _cut(batches):
    """Windows of each text, at places that its hash gives."""
    for batch in batches:
        raw, at = column_bytes(batch.column(1))
        times = np.asarray(batch.column(3))
        row = np.repeat(np.arange(batch.num_rows), times)
        draw = mixed(np.asarray(batch.column(2)).astype(np.uint64)[row] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64))
        room = np.maximum(1, np.diff(at) - WINDOW).astype(np.uint64)
        start = at[row] + (draw % room[row]).astype(np.int64)
        data = memoryview(raw)
        cut = [bytes(data[a : min(a + WINDOW + AHEAD, b)]) for a, b in zip(start.tolist(), at[row + 1].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cut, pa.binary()), pa.array((draw >> np.uint64(1)).astype(np.int64))], ["lang", "window", "draw"])


def training_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """(lang, window, draw): at most `most` windows of labelled texts with a letter, about as many of each language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = known.groupBy(F.col(lang).alias("__lang")).count().orderBy(F.desc("count"), "__lang").limit(languages).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, window binary, draw long")
    quota = most / len(counts)
    share = docs.sparkSession.createDataFrame([(r["__lang"], min(1.0, quota / r["count"]), min(PER_TEXT, -(-int(quota) // r["count"]) or 1)) for r in counts], "__lang string, __share double, times int")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), key, text), 1)
    rows = known.join(F.broadcast(share), F.col(lang) == F.col("__lang")).select(F.col("__lang").alias("lang"), F.col(text).cast("string").alias("text"), draw.alias("draw"), "__share", "times")
    chosen = rows.where((F.col("draw") < F.col("__share") * float(1 << 63)) & F.col("text").rlike(r"\p{L}"))
    return chosen.select("lang", "text", F.xxhash64("draw").bitwiseAND((1 << 62) - 1).alias("draw"), "times").mapInArrow(_cut, "lang string, window binary, draw long").orderBy("draw", "window", "lang").limit(most)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE, epochs: int = EPOCHS) -> Network | None:
    """The network of a bounded sample of labelled texts, or None if there are none."""
    with small_batches(docs.sparkSession):
        rows = training_windows(docs, key, text, lang, most).collect()
    if not rows:
        return None
    network = Network(sorted({r.lang for r in rows}))
    data = np.frombuffer(b"".join(r.window for r in rows), np.uint8)
    ends = np.cumsum([len(r.window) for r in rows])
    number = {name: k for k, name in enumerate(network.languages)}
    network.fit(windows(data, np.concatenate([[0], ends[:-1]]), ends), np.array([number[r.lang] for r in rows]), epochs)
    return network


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """docs without the text, with lang_pred and score. Only the text is read for it."""
    kept = [c for c in docs.columns if c not in (text, *RESULTS)]
    if network is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    names = [*kept, *RESULTS]
    rows = docs.select(*kept, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"), text_or_empty(text).alias("__text"))

    def run(batches):
        net = shared.value
        for batch in batches:
            *own, letter, column = batch.columns
            share, letter = net.texts(*column_bytes(column)), np.asarray(letter)
            best = share.argmax(axis=1)
            lang = [net.languages[b] if some else "und" for b, some in zip(best.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(np.where(letter, share[np.arange(len(best)), best], 0.0))], names)

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs.where(remainder() != 2).select("doc_id", "text", "lang"))
    with small_batches(spark):
        return cut_lineage(predict(docs.select("doc_id", (remainder() == 2).alias("held_out"), "text"), network))
