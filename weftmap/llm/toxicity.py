"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all lower-cased words of the examples. A term weighs idf, and a term
that is tied to a label beyond chance (chi-square, corrected for the number of
words tested) weighs 1 + ``TIED`` times that, whichever label it is.
Examples and texts are vectors of (1 + log tf) times that weight, of length one;
words that no example has count in a text's length. The
index keeps, for each term, postings in blocks of examples and the greatest
weight of each block; a text's blocks are visited from the highest bound down
until no block can change its ``K`` nearest, so these are exact. Votes weigh by
cosine, with ``PRIOR`` votes at the base rate, which makes the score calibrated:
a text without a word of any example gets the share of toxic examples among
those without a word. Evidence: the nearest examples' ids and cosines.

Examples are different texts, at most ``EXAMPLES`` of each label, chosen and put in
order by a hash of the text, so ids have no part in a score; votes weigh by how many
texts of their label an example stands for. The index is broadcast; it grows with the
words of the examples, not with the input. Texts are all scored, whole.

Defined results: null and empty texts have no terms; an id labelled more than
once, and a text with several labels, counts with its highest label; rows with a null
label or id are no examples; without examples of both labels every score is 0; ties
among examples go to the lower place in the index; repeated rows are scored alike; a
kept column named like one that is made comes back with ``_in`` at the end of its name;
ids may be of any type that can be joined on, and evidence is of that type; a very long
text is scored alone and whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from . import wordhash as H
from .common import batches, carry, columns, held_out, materialize, text_bytes

EXAMPLES, MIN_DOCS = 6000, 5
K, PRIOR, BLOCK = 25, 1.0, 64
#: A word that one example in so many has is a row of the matrix; texts that are multiplied with it at a time.
DENSE, BATCH = 12, 64
#: Chance that any word is taken for tied to a label by accident.
ALPHA = 0.01
#: How much more such a word weighs, one factor for all: the best by accuracy at a score of 0.3, four-fold over the labelled
#: rows of sf0.1 that aren't held out, of 0, 1, 2, 3, 4, 6, 8, 12 (0.939, 0.975, 0.987, 0.987, 0.987, 0.985, 0.983, 0.981) and of
#: five shapes that grow with chi-square, the share of labels told or the odds at these strengths (at most 0.9869, this one 0.9872).
TIED = 4.0
#: Results that a worker keeps for copies of a text.
KEPT = 20_000


def words_of(texts: pa.Array) -> H.Words:
    return H.Words(*text_bytes(pc.utf8_lower(texts)), inside=H.LETTER)


def doc_terms(words: H.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different words and how often: (first of each text, hash, times)."""
    n = len(words.counts)
    own, back = np.unique(words.hash, return_inverse=True)
    width = max(1, len(own))
    key, times = np.unique(words.doc() * width + back, return_counts=True)
    return np.searchsorted(key // width, np.arange(n + 1)), own[key % width], times


def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, doc_id, toxic, text) -> (th, doc_id, toxic, terms, times): the words of each text, as 64-bit and 32-bit numbers."""
    for rows, texts in batches(it):
        first, term, times = doc_terms(words_of(texts))
        cut = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        to_bytes = lambda x: pa.array([x[a:b].tobytes() for a, b in cut], pa.binary())
        yield pa.RecordBatch.from_arrays([*columns(rows, ("th", "doc_id", "toxic")), to_bytes(term.astype("<u8")), to_bytes(times.astype("<u4"))], ["th", "doc_id", "toxic", "terms", "times"])


def found_terms(words: H.Words, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text the vocabulary's terms and how often: (first of each text, term, times), and its sum of squares of 1 + log times over other words."""
    first, h, times = doc_terms(words)
    n = len(words.counts)
    if not len(terms) or not len(h):
        return np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n)
    own, back = np.unique(h, return_inverse=True)
    k = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
    hit = (terms[k] == own)[back]
    doc = np.repeat(np.arange(n), np.diff(first))
    other = np.bincount(doc[~hit], (1 + np.log(times[~hit])) ** 2, minlength=n)
    doc, term, times = doc[hit], k[back[hit]], times[hit]
    return np.searchsorted(doc, np.arange(n + 1)), term, times, other


def label_weights(df: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """What each term's idf is multiplied by, from in how many examples and toxic examples it is: 1, or more if it is tied to a label beyond chance."""
    a, b = toxic.astype(np.float64), (df - toxic).astype(np.float64)
    c, d = n1 - a, n0 - b
    chi = np.where(c + d > 0, (n0 + n1) * (a * d - b * c) ** 2 / (np.maximum((a + b) * (c + d), 1) * n1 * n0), 0.0)
    tested = df >= MIN_DOCS
    # the normal tail bound exp(-chi / 2) is no less than the chance of such a value
    limit = 2 * np.log(max(1, tested.sum()) / ALPHA)
    return np.where(tested & (chi > limit), 1 + TIED, 1.0)


class Index:
    """The examples: block-max postings over unit vectors."""

    #: The type of the examples' ids.
    kind: DataType = LongType()

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, label: np.ndarray, first: np.ndarray, term: np.ndarray, times: np.ndarray, votes: tuple[float, float] = (1.0, 1.0)):
        self.terms, self.idf = terms, idf
        self.unseen = float(np.log(1 + len(ids)) + 1)  # the idf of a word that no example has
        vote = np.where(label == 1, votes[1], votes[0])
        self.rate = float((vote * label).sum() / vote.sum()) if len(label) else 0.0
        size = np.diff(first)
        none = size == 0
        #: Base rate of the examples without a term.
        self.empty = float(((vote * label)[none].sum() + self.rate) / (vote[none].sum() + 1.0)) if len(label) else 0.0
        weight = (1 + np.log(times)) * idf[term] if len(term) else np.empty(0)
        doc = np.repeat(np.arange(len(size)), size)
        norm = np.sqrt(np.bincount(doc, weight**2, minlength=len(size)))
        weight = weight / np.maximum(norm[doc], 1e-12)
        keep = np.flatnonzero(~none)
        place = np.full(len(size), -1)
        # like examples side by side, by the heaviest word that may fill a block: blocks then have tight bounds
        often = np.bincount(term, minlength=len(terms)) >= BLOCK
        heavy = np.where(often[term], weight, weight - 2) if len(term) else weight
        lead = np.array([term[first[d] + np.argmax(heavy[first[d] : first[d + 1]])] for d in keep], np.int64) if len(keep) else keep
        keep = keep[np.lexsort((keep, lead))] if len(keep) else keep
        place[keep] = np.arange(len(keep))
        self.ids, self.label, self.vote = ids[keep], label[keep].astype(np.float64), vote[keep]
        doc = place[doc].astype(np.min_scalar_type(len(keep)))
        weight = weight.astype(np.float32)
        # words of many examples: rows of a matrix, made where it is used
        often = np.bincount(term, minlength=len(terms)) * DENSE >= max(1, len(keep))
        self.row = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        of = often[term]
        self.cells = self.row[term[of]], doc[of], weight[of]
        self.dense: np.ndarray | None = None
        term, doc, weight = term[~of], doc[~of], weight[~of]
        order = np.lexsort((doc, term))
        term, self.doc, self.weight = term[order], doc[order], weight[order]
        self.blocks = -(-len(keep) // BLOCK)
        # a run is a term's postings in a block
        block = self.doc // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.run_at = np.append(at, len(term)).astype(np.int32)
        self.run_block = block[at]
        self.bound = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0, np.float32)
        self.start = np.searchsorted(term[at], np.arange(len(terms) + 1)).astype(np.int32)
        self.kept: dict[bytes, tuple] = {}

    def weights(self, term: np.ndarray, times: np.ndarray, other: float) -> np.ndarray:
        """A text's weights; ``other`` is the sum of squared weights of its words that no example has."""
        weight = (1 + np.log(times)) * self.idf[term]
        return weight / np.sqrt((weight**2).sum() + other)

    def shares(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the matrix's words give to the cosines of some texts (term, weight), at most BATCH, with all examples."""
        if self.dense is None:
            self.dense = np.zeros((int(self.row.max(initial=-1)) + 1, self.blocks * BLOCK))
            self.dense[self.cells[0], self.cells[1]] = self.cells[2]
        # of one shape whatever the number of texts, so that a text's sums are alike in any batch
        own = np.zeros((BATCH, len(self.dense)))
        for k, (term, weight) in enumerate(texts):
            row = self.row[term]
            own[k, row[row >= 0]] = weight[row >= 0]
        return own @ self.dense

    def _add(self, total: np.ndarray, run: np.ndarray, own: np.ndarray) -> None:
        """Adds the postings of some runs, from the text's weight for each run."""
        first = self.run_at[run]
        size = self.run_at[run + 1] - first
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        total += np.bincount(self.doc[at], np.repeat(own, size) * self.weight[at], minlength=len(total))

    def nearest(self, term: np.ndarray, times: np.ndarray, k: int = K, other: float = 0.0, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (those of cosine 0 left out).

        A block's bound is the greatest share of the matrix's words plus the bounds
        of the others. The blocks of the highest bounds give a k-th best cosine; of
        the others only those whose bound reaches it are looked at.
        """
        weight = self.weights(term, times, other)
        total = (self.shares([(term, weight)])[0] if share is None else share).copy()
        size = self.start[term + 1] - self.start[term]
        run = np.repeat(self.start[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own = np.repeat(weight, size)
        block = self.run_block[run]
        bound = np.bincount(block, own * self.bound[run], minlength=self.blocks) + total.reshape(-1, BLOCK).max(1)
        lead = np.zeros(self.blocks, bool)
        lead[np.argsort(-bound, kind="stable")[: -(-k // BLOCK) + 1]] = True
        some = lead[block]
        self._add(total, run[some], own[some])
        scores = total.reshape(-1, BLOCK)[lead].ravel()
        least = np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9 if len(scores) >= k else 0.0
        rest = ~lead & (bound >= least) & (bound > 0)
        some = rest[block]
        self._add(total, run[some], own[some])
        docs = np.flatnonzero(np.repeat(lead | rest, BLOCK) & (total > 0) & (total >= least - 1e-9))
        scores = total[docs]
        top = np.lexsort((docs, -np.round(scores, 9)))[:k]
        return docs[top], scores[top]

    def score(self, first: np.ndarray, term: np.ndarray, times: np.ndarray, other: np.ndarray) -> list[tuple[float, list, list]]:
        """The score, evidence and cosines of each text; ``other`` is its sum of squares of 1 + log times over words that no example has."""
        out: list = [(self.empty, [], [])] * len(other)
        if not len(self.ids):
            return out
        todo: dict[bytes, list[int]] = {}
        for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if a == b:
                continue
            key = hashlib.blake2b(term[a:b].tobytes() + times[a:b].tobytes() + other[d].tobytes(), digest_size=16).digest()
            if key in self.kept:
                out[d] = self.kept[key]
            else:
                todo.setdefault(key, []).append(d)
        if len(self.kept) > KEPT:
            self.kept.clear()
        todo_keys = list(todo)
        for at in range(0, len(todo_keys), BATCH):
            keys = todo_keys[at : at + BATCH]
            texts = [(slice(first[d], first[d + 1]), float(other[d]) * self.unseen**2) for d in (todo[key][0] for key in keys)]
            shares = self.shares([(term[x], self.weights(term[x], times[x], o)) for x, o in texts])
            for key, (x, o), share in zip(keys, texts, shares, strict=False):
                docs, cosine = self.nearest(term[x], times[x], other=o, share=share)
                vote = cosine * self.vote[docs]
                score = float(((vote * self.label[docs]).sum() + PRIOR * self.rate) / (vote.sum() + PRIOR))
                got = (min(1.0, max(0.0, score)), self.ids[docs[:5]].tolist(), cosine[:5].tolist())
                self.kept[key] = got
                for d in todo[key]:
                    out[d] = got
        return out


def examples(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame | None, tuple[float, float]]:
    """(th, doc_id, toxic, text) of the example texts, and what a vote of each label weighs. At most twice ``most`` hashes come to the driver."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("wm_label_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.where(~held_out("wm_label_id"))
    light = docs.select("doc_id", F.xxhash64("text").alias("th"))
    found = light.join(known, F.col("doc_id") == F.col("wm_label_id")).groupBy("th").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    found = materialize(found, "labelled")
    of = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of) < 2:
        return None, (1.0, 1.0)
    some = [found.where(F.col("toxic") == t).orderBy("th").limit(most) for t in (0, 1)]
    chosen = [(r["th"], r["doc_id"], r["toxic"]) for r in some[0].unionByName(some[1]).collect()]
    stands = [of[t] / min(of[t], most) for t in (0, 1)]
    mean = sum(of.values()) / len(chosen)
    label = F.broadcast(docs.sparkSession.createDataFrame(chosen, found.schema).withColumnsRenamed({"th": "wm_th", "doc_id": "wm_id"}))
    texts = docs.select("doc_id", "text").join(label, (F.col("doc_id") == F.col("wm_id")) & (F.xxhash64("text") == F.col("wm_th")))
    one = texts.groupBy(F.col("wm_th").alias("th")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    return materialize(one, "examples"), (stands[0] / mean, stands[1] / mean)


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Index:
    """The index from documents that aren't held out and have a label."""
    none = np.empty(0, np.int64)
    texts, votes = examples(docs, labels, most)
    if texts is None:
        return Index(np.empty(0, np.uint64), np.empty(0), none, none, np.zeros(1, np.int64), none, none)
    kind = docs.schema["doc_id"].dataType
    rows = texts.mapInArrow(vectors, f"th long, doc_id {kind.simpleString()}, toxic long, terms binary, times binary").toArrow()
    rows = rows.sort_by("th").combine_chunks()
    flat = lambda c, kind: np.concatenate([np.frombuffer(b"".join(x.to_pylist()), kind) for x in rows.column(c).chunks])
    ids, toxic = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.column("toxic").to_numpy()
    size = pc.binary_length(rows.column("terms")).to_numpy() // 8
    times = flat("times", "<u4")
    term, back = np.unique(flat("terms", "<u8"), return_inverse=True)
    back = back.astype(np.int32)
    del rows
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    df = np.bincount(back, minlength=len(term))
    in_toxic = np.bincount(back[np.repeat(toxic, size) == 1], minlength=len(term))
    idf = (np.log((1 + n0 + n1) / (1 + df)) + 1) * label_weights(df, in_toxic, n0, n1)
    index = Index(term, idf, ids, toxic, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), back, times, votes)
    index.kind = kind
    return index


def judge(shared, keep: list[str], text: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        ids = pa.list_(to_arrow_type(index.kind))
        for rows, texts in batches(it, text):
            first, term, times, other = found_terms(words_of(texts), index.terms)
            got = index.score(first, term, times, other)
            yield pa.RecordBatch.from_arrays(
                [*columns(rows, keep), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], ids), pa.array([g[2] for g in got], pa.list_(pa.float64()))],
                [*keep, "score", "evidence", "cosines"],
            )

    return run


def score(docs: DataFrame, keep: list[str], index: Index) -> DataFrame:
    """``keep`` columns with score, evidence (ids of the nearest examples) and cosines. No shuffle."""
    own, names, (text,), schema = carry(docs, keep, f"score double, evidence array<{index.kind.simpleString()}>, cosines array<double>")
    return own.mapInArrow(judge(docs.sparkSession.sparkContext.broadcast(index), names, text), schema)
