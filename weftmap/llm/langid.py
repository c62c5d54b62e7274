"""Language ID: a byte convolutional network trained here in numpy.

Bytes are embedded, passed through filters of several widths, max-pooled over
a window and classified by softmax. A whole text is cut into windows of fixed
length that overlap by the widest filter, all of them are judged in batches, and
the text's probabilities are the windows' means, weighted by their bytes.

Training takes different labelled texts of every language, chosen by a hash of the
text, so ids have no part: at most ``TRAIN_DOCS`` of each, or fewer of each where there
are more than ``FULL_LANGS`` languages, so that all together are about as many (one of
each at least); and at most ``TRAIN_WINDOWS`` windows of each, drawn with the hash as
seed; everything else runs over all texts. The weights are a few thousand numbers
whatever the input.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without any labelled text all are ``und``; repeated rows are judged alike; a kept
column named like one that is made comes back with ``_in`` at the end of its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import batches, carry, columns, held_out, text_bytes

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
TRAIN_DOCS, TRAIN_WINDOWS, FULL_LANGS, EPOCHS = 250, 8, 64, 6
#: Parts of a language in which training texts are looked for.
PARTS = 64
UND = "und"


class Net:
    """Weights; for inference a table of each byte's share in each filter's places."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self.tables: list[list[np.ndarray]] | None = None

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def freeze(self) -> Net:
        self.tables = [[np.ascontiguousarray(self.embed @ f[j]) for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        return self

    def pooled(self, windows: np.ndarray, places: bool = False):
        """The greatest response of each filter in each window (and where)."""
        tables = self.tables or [[self.embed @ f[j] for j in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        top, at = [], []
        for w, table, b in zip(WIDTHS, tables, self.bias, strict=True):
            n = windows.shape[1] - w + 1
            sums = table[0][windows[:, :n]]
            for j in range(1, w):
                sums += table[j][windows[:, j : j + n]]
            if places:
                k = sums.argmax(1)
                at.append(k)
                top.append(np.take_along_axis(sums, k[:, None, :], 1)[:, 0] + b)
            else:
                top.append(sums.max(1) + b)
        top = np.concatenate(top, 1)
        return (top, at) if places else top

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows), 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        top, at = self.pooled(windows, True)
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(label)), label] -= 1
        z /= len(label)
        d_hidden = (z @ self.out.T) * (top > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias = [], []
        for i, (w, f, k) in enumerate(zip(WIDTHS, self.filters, at, strict=True)):
            d = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
            d_bias.append(d.sum(0))
            own = np.zeros_like(f)
            for j in range(w):
                byte = np.take_along_axis(windows, k + j, 1)  # only the pooled place has a gradient
                own[j] = np.einsum("bf,bfe->ef", d, self.embed[byte])
                np.add.at(d_embed, byte.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, EMBED))
            d_filters.append(own)
        return [d_embed, *d_filters, *d_bias, hidden.T @ z, z.sum(0)]

    def train(self, windows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 0.01, seed: int = 11) -> Net:
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.params()]
        second = [np.zeros_like(p) for p in self.params()]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(label))
            for a in range(0, len(order), size):
                some = order[a : a + size]
                step += 1
                for p, g, m, v in zip(self.params(), self.gradients(windows[some], label[some]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * 0.5**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self.freeze()


def cut(raw: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of first bytes, texts, bytes that are new) of all windows."""
    step = window - max(WIDTHS) + 1
    size = np.diff(at)
    n = np.where(size > 0, np.maximum(1, -(-(size - max(WIDTHS) + 1) // step)), 0)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = at[:-1][doc] + k * step
    return start, doc, np.minimum(step, at[1:][doc] - start)


def rows_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Windows as a matrix of bytes, 0 beyond a text's end."""
    place = start[:, None] + np.arange(window)
    return np.where(place < end[:, None], raw[np.minimum(place, max(0, len(raw) - 1))], np.uint8(0))


def sample(docs: DataFrame, docs_each: int = TRAIN_DOCS, full_langs: int = FULL_LANGS) -> list:
    """(lang, windows as bytes) of texts of all languages; windows are drawn on the executors, so no whole text comes to the driver."""
    may = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    light = may.select("doc_id", F.col("lang").alias("wm_lang"), F.xxhash64("text").alias("wm_h"))
    kinds = light.groupBy("wm_lang", "wm_h").agg(F.min("doc_id").alias("wm_id"))
    langs = may.select("lang").distinct().count()
    each = min(docs_each, max(1, docs_each * full_langs // max(1, langs)))
    # the first of each part of a language, then of these, so no task sees all texts of one language
    first = lambda df, *by: df.withColumn("wm_n", F.row_number().over(Window.partitionBy(*by).orderBy("wm_h"))).where(F.col("wm_n") <= each).drop("wm_n")
    parts = first(kinds.withColumn("wm_part", F.pmod(F.shiftright("wm_h", 32), F.lit(PARTS))), "wm_lang", "wm_part")
    chosen = first(parts, "wm_lang").select("wm_lang", "wm_h", "wm_id").collect()
    if not chosen:
        return []
    given = F.broadcast(docs.sparkSession.createDataFrame(chosen, kinds.schema))
    met = may.join(given, (F.col("doc_id") == F.col("wm_id")) & (F.col("lang") == F.col("wm_lang")) & (F.xxhash64("text") == F.col("wm_h")))
    texts = met.dropDuplicates(["wm_lang", "wm_h"]).select("wm_h", "lang", "text")

    def draw(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in batches(it):
            raw, at = text_bytes(column)
            start, doc, _ = cut(raw, at)
            langs, out = [], []
            for d, (i, lang) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                own = start[doc == d]
                own = own[np.random.default_rng(i & 0xFFFFFFFFFFFFFFFF).permutation(len(own))[:TRAIN_WINDOWS]]
                for row in rows_of(raw, own, np.full(len(own), at[d + 1])):
                    langs.append(lang), out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    return texts.mapInArrow(draw, "lang string, window binary").collect()


def fit(docs: DataFrame) -> Net | None:
    """A network from (doc_id, text, lang); None if no language can be learned."""
    rows = sorted((r["lang"], bytes(r["window"])) for r in sample(docs))
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return None
    windows = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return Net(langs).train(windows, np.searchsorted(langs, [lang for lang, _ in rows]))


def judge(shared, keep: list[str], text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for rows, texts in batches(it, text):
            raw, at = text_bytes(texts)
            n = len(at) - 1
            start, doc, new = cut(raw, at)
            total = np.zeros((n, len(net.langs)))
            for a in range(0, len(start), 64):
                b = slice(a, a + 64)
                p = net.probabilities(rows_of(raw, start[b], at[1:][doc[b]])) * new[b, None]
                np.add.at(total, doc[b], p)
            total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
            best = total.argmax(1)
            known = np.array([any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            lang = [net.langs[b] if k else UND for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, total[np.arange(n), best], 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([*columns(rows, keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, keep: list[str], net: Net | None) -> DataFrame:
    """``keep`` columns with lang_pred and score. No shuffle."""
    own, names, (text,), schema = carry(docs, keep, "lang_pred string, score double")
    if net is None:
        return own.select(*names, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    return own.mapInArrow(judge(docs.sparkSession.sparkContext.broadcast(net), names, text), schema)
