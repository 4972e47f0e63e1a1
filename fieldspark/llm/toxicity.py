"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its first letters, so that inflected
forms share their stem. Filters of several widths slide over the word vectors; each filter's maximum over the text
goes through a rectifier into a logistic unit. Since a filter is linear, its products with the distinct words are
computed once per batch and only added up along the text.

All labelled rows are learnt from: each epoch runs over shards of them in parallel, and the shards' changes are averaged.
Decision thresholds are calibrated by language on rows kept out of training; the language is guessed from the
text's own function words. The score is shifted so that the calibrated threshold is 0.5.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.scale import bounded_broadcast, cut_lineage

from .tables import mix64, slices

#: Labelled rows that one task learns from in an epoch, on average.
SHARD_ROWS = 8192
#: Buckets of the embedding whose changes are averaged together.
BLOCK_BUCKETS = 1024
#: Steps of a logit in the histograms that thresholds are read from.
LOGIT_STEPS = 128
#: Words of a text that are convolved at a time; texts of any length go through piece by piece.
PIECE_WORDS = 200_000
#: Texts whose words are numbered together.
TEXTS_AT_ONCE = 400

# Frequent function words that tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit von zu den dem ein auf für im sich auch als an",
    "en": "the of and to in is that it for with was on are this by from be as at",
    "es": "el los las y por con una del se para no es lo como más pero sus le ya",
    "fr": "le les des et est que dans pour une qui du au sur pas avec ce il sont aux",
}
LANGUAGES = ("", *FUNCTION_WORDS)
#: Letters of a word hashed as a matrix; longer words are hashed one by one.
LETTERS = 24
WORDS_AT_ONCE = 16_384
_POWERS = np.cumprod(np.full(LETTERS, 0x9E3779B97F4A7C15, np.uint64))
_LANGUAGE_OF = {w: k for k, name in enumerate(LANGUAGES) if name for w in FUNCTION_WORDS[name].split()}


@dataclass
class Settings:
    buckets: int = 1 << 16
    size: int = 16
    filters: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    stems: tuple[int, ...] = (3, 4, 5, 6)
    epochs: int = 3
    batch: int = 32
    rate: float = 0.08
    decay: float = 1e-4
    seed: int = 7


# ---------------------------------------------------------------- text to word numbers

def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the texts as numbers of those words, and where each text starts."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    words, numbers = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    # an empty text splits into one empty word
    if "" in words:
        keep = numbers != words.index("")
        kept = np.concatenate([[0], np.cumsum(keep)])
        return words, numbers[keep], kept[starts]
    return words, numbers, starts


def word_buckets(words: list[str], s: Settings) -> np.ndarray:
    """Hash buckets of each word: the word itself and its stems; words without letters or digits are one word."""
    if len(words) > WORDS_AT_ONCE:
        return np.concatenate([word_buckets(words[k:k + WORDS_AT_ONCE], s) for k in range(0, len(words), WORDS_AT_ONCE)])
    bare = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in words]
    letters = np.array(bare or [""], f"U{LETTERS}").view(np.uint32).reshape(-1, LETTERS)[:len(bare)].astype(np.uint64)
    sums = np.cumsum(letters * _POWERS, axis=1, dtype=np.uint64)
    whole = sums[:, -1].copy()
    for i, w in enumerate(bare):
        if len(w) > LETTERS:
            whole[i] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    hashes = [mix64(whole)] + [mix64(sums[:, n - 1] + np.uint64(n)) for n in s.stems]
    return (np.stack(hashes, 1) % np.uint64(s.buckets)).astype(np.int32)


def guess_languages(words: list[str], numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The language whose function words are most frequent in each text; 0 if there are none."""
    code = np.array([_LANGUAGE_OF.get(w, 0) for w in words] or [0], np.int64)[numbers] if len(numbers) else np.zeros(0, np.int64)
    at = np.flatnonzero(code)
    row = np.searchsorted(starts, at, "right") - 1
    votes = np.zeros((len(starts) - 1, len(LANGUAGES)), np.int64)
    np.add.at(votes, (row, code[at]), 1)
    return votes.argmax(1)


@dataclass
class Packed:
    """Texts as numbers of their distinct words, of which only hash and buckets are held."""

    hashes: np.ndarray
    buckets: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    languages: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Packed:
        part = [self.numbers[self.starts[r]:self.starts[r + 1]] for r in rows]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int64)
        return Packed(self.hashes, self.buckets, np.concatenate([np.zeros(0, np.int32), *part]), starts, self.languages[rows])


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def pack(texts: pa.Array, s: Settings) -> Packed:
    words, numbers, starts = split_words(texts)
    return Packed(word_hashes(words), word_buckets(words, s).astype(np.uint16 if s.buckets <= 1 << 16 else np.int32),
                  numbers.astype(np.int32), starts, guess_languages(words, numbers, starts))


# ---------------------------------------------------------------- the network

@dataclass
class Model:
    settings: Settings
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    constant: float | None = None
    thresholds: dict[int, float] = field(default_factory=dict)

    @staticmethod
    def start(s: Settings) -> Model:
        rng = np.random.default_rng(s.seed)
        return Model(
            s, rng.normal(0, 0.1, (s.buckets, s.size)).astype(np.float32),
            {w: rng.normal(0, 0.5, (w, s.size, s.filters)).astype(np.float32) for w in s.widths},
            {w: np.zeros(s.filters, np.float32) for w in s.widths},
            rng.normal(0, 0.3, s.filters * len(s.widths)).astype(np.float32), 0.0,
        )

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        """A vector per word, and a last one of zeros for the padding."""
        out = np.zeros((len(buckets) + 1, self.settings.size), np.float32)
        for column in buckets.T:
            out[:-1] += self.embedding[column]
        return out

    def pooled(self, vectors: np.ndarray, numbers: np.ndarray, starts: np.ndarray, argmax: bool = False, goes_on: np.ndarray | None = None):
        """Maximum of every filter over every text, [texts, filters]; with ``argmax`` also its position in ``padded``.

        A text that ``goes_on`` elsewhere has no windows that reach past its last word.
        """
        pad = max(self.settings.widths) - 1
        n = len(starts) - 1
        lengths = np.diff(starts)
        begin = starts[:-1] + (pad + 1) * np.arange(n)
        padded = np.full(len(numbers) + (pad + 1) * n, len(vectors) - 1, np.int64)
        padded[np.arange(len(numbers)) + np.repeat((pad + 1) * np.arange(n), lengths)] = numbers
        tops, places = [], []
        for w in self.settings.widths:
            products = [vectors @ self.filters[w][j] for j in range(w)]
            y = products[0][padded]
            for j in range(1, w):
                y[:-j] += products[j][padded[j:]]
            for j in range(1, w):  # windows that reach into the next text count as padding
                y[begin + lengths + pad + 1 - j] = 0
            if goes_on is not None and goes_on.any():
                for j in range(1 - w, pad + 1):
                    y[(begin + lengths + j)[goes_on]] = -np.inf
            top = np.maximum.reduceat(y, begin, axis=0)
            tops.append(top)
            if argmax:
                row = np.repeat(np.arange(n), lengths + pad + 1)
                place = np.zeros_like(top, dtype=np.int64)
                for f in range(y.shape[1]):
                    hit = np.flatnonzero(y[:, f] == top[row, f])[::-1]
                    place[row[hit], f] = hit  # the first of equal positions stays
                places.append(place)
        return (np.concatenate(tops, 1), np.concatenate(places, 1), padded) if argmax else np.concatenate(tops, 1)

    def pooled_in_pieces(self, vectors: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The same in bounded memory: texts are cut into pieces that overlap by the widest filter less one."""
        over = max(self.settings.widths) - 1
        cuts, owner, a = [], [], 0
        for t, (first, last) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            a = first
            while True:
                b = min(last, a + PIECE_WORDS)
                cuts.append((a, b))
                owner.append(t)
                if b == last:
                    break
                a = b - over
        out = np.full((len(starts) - 1, len(self.out)), -np.inf, np.float32)
        k = 0
        while k < len(cuts):
            end, size = k, 0
            while end < len(cuts) and (end == k or size + cuts[end][1] - cuts[end][0] <= PIECE_WORDS):
                size += cuts[end][1] - cuts[end][0]
                end += 1
            part = [numbers[a:b] for a, b in cuts[k:end]]
            at = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            goes_on = np.array([b < starts[t + 1] for (_, b), t in zip(cuts[k:end], owner[k:end], strict=True)])
            np.maximum.at(out, owner[k:end], self.pooled(vectors, np.concatenate(part), at, goes_on=goes_on))
            k = end
        return out

    def pooled_words(self, vectors: np.ndarray, numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maximum of every filter over every text and the words at it, per width [texts, filters, width]; in bounded memory."""
        over, n, s = max(self.settings.widths) - 1, len(starts) - 1, self.settings
        out = np.full((n, len(self.out)), -np.inf, np.float32)
        words = [np.full((n, s.filters, w), len(vectors) - 1, np.int64) for w in s.widths]

        def look(rows: np.ndarray, part: list[np.ndarray], goes_on: np.ndarray | None) -> None:
            at = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            top, place, padded = self.pooled(vectors, np.concatenate(part), at, argmax=True, goes_on=goes_on)
            better = top > out[rows]  # the first of equal positions stays
            out[rows] = np.where(better, top, out[rows])
            for i, w in enumerate(s.widths):
                cols = slice(i * s.filters, (i + 1) * s.filters)
                found = padded[np.minimum(place[:, cols, None] + np.arange(w), len(padded) - 1)]
                words[i][rows] = np.where(better[:, cols, None], found, words[i][rows])

        lengths = np.diff(starts)
        rows = np.flatnonzero(lengths <= PIECE_WORDS)
        for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(lengths[rows]) // PIECE_WORDS)) + 1):
            if len(some):
                look(some, [numbers[starts[t]:starts[t + 1]] for t in some], None)
        for t in np.flatnonzero(lengths > PIECE_WORDS):
            for a in range(starts[t], starts[t + 1] - over, PIECE_WORDS - over):
                b = min(starts[t + 1], a + PIECE_WORDS)
                look(np.array([t]), [numbers[a:b]], np.array([b < starts[t + 1]]))
        return out, words

    def logits(self, texts: Packed) -> np.ndarray:
        """Raw logit of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        used, local = np.unique(texts.numbers, return_inverse=True)
        top = self.pooled_in_pieces(self.vectors(texts.buckets[used]), local, texts.starts)
        bias = np.concatenate([self.bias[w] for w in self.settings.widths])
        return np.maximum(top + bias, 0) @ self.out + self.out_bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        packed = pack(texts, self.settings)
        logit, language = self.logits(packed), packed.languages
        shift = np.array([self.thresholds.get(k, self.thresholds.get(-1, 0.0)) for k in range(len(LANGUAGES))])
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64) - shift[language], -40, 40)))


class Trainer:
    """AdaGrad on the logistic loss. Only the words at a filter's maximum get a gradient."""

    def __init__(self, model: Model, rate: float):
        s = model.settings
        self.model, self.rate = model, rate
        model.out_bias = float(np.log(rate / (1 - rate)))
        self.square = {"e": np.full(s.buckets, 1e-3, np.float32), "o": np.full(len(model.out), 1e-3), "c": 1e-3}
        self.square |= {("f", w): np.full_like(model.filters[w], 1e-3) for w in s.widths}
        self.square |= {("b", w): np.full_like(model.bias[w], 1e-3) for w in s.widths}

    def step(self, value, grad, key):
        self.square[key] = self.square[key] + grad * grad
        return value - self.model.settings.rate * grad / np.sqrt(self.square[key])

    def learn(self, texts: Packed, labels: np.ndarray, order: np.ndarray) -> None:
        """One pass over the rows ``order``."""
        model, s = self.model, self.model.settings
        numbers, starts, buckets = texts.numbers, texts.starts, texts.buckets
        weight = np.where(labels == 1, 0.5 / self.rate, 0.5 / (1 - self.rate))
        for k in range(0, len(order), s.batch):
            rows = order[k:k + s.batch]
            part = [numbers[starts[r]:starts[r + 1]] for r in rows]
            at = np.concatenate([[0], np.cumsum([len(p) for p in part])])
            used, local = np.unique(np.concatenate(part), return_inverse=True)
            vectors = model.vectors(buckets[used])
            top, words = model.pooled_words(vectors, local, at)
            pre = top + np.concatenate([model.bias[w] for w in s.widths])
            hidden = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))
            d = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            dh = d[:, None] * model.out * (pre > 0)
            d_vectors = np.zeros_like(vectors)
            for i, w in enumerate(s.widths):
                g = dh[:, i * s.filters:(i + 1) * s.filters]
                d_filter = np.zeros_like(model.filters[w])
                for j in range(w):
                    word = words[i][:, :, j]
                    np.add.at(d_vectors, word, g[:, :, None] * model.filters[w][j].T)
                    d_filter[j] = np.einsum("tfs,tf->sf", vectors[word], g)
                model.filters[w] = self.step(model.filters[w], d_filter + s.decay * model.filters[w], ("f", w))
                model.bias[w] = self.step(model.bias[w], g.sum(0), ("b", w))
            touched = np.flatnonzero(np.abs(d_vectors[:-1]).sum(1))
            rows_e, inverse = np.unique(buckets[used[touched]], return_inverse=True)
            grad = np.zeros((len(rows_e), s.size), np.float32)
            np.add.at(grad, inverse.reshape(-1), np.repeat(d_vectors[touched], buckets.shape[1], 0))
            grad += s.decay * model.embedding[rows_e]
            self.square["e"][rows_e] += (grad * grad).mean(1)
            model.embedding[rows_e] -= s.rate * grad / np.sqrt(self.square["e"][rows_e])[:, None]
            model.out = self.step(model.out, hidden.T @ d + s.decay * model.out, "o").astype(np.float32)
            model.out_bias = float(self.step(model.out_bias, d.sum(), "c"))

    def small(self) -> np.ndarray:
        """All values but those of the embedding, in one row."""
        m, q = self.model, self.square
        parts = [x for w in m.settings.widths for x in (m.filters[w], m.bias[w], q["f", w], q["b", w])]
        return np.concatenate([np.ravel(x).astype(np.float64) for x in (*parts, m.out, m.out_bias, q["o"], q["c"])])

    def set_small(self, row: np.ndarray) -> None:
        m, q, at = self.model, self.square, 0

        def next_like(x):
            nonlocal at
            size = np.size(x)
            at += size
            return row[at - size:at].reshape(np.shape(x)).astype(np.asarray(x).dtype)

        for w in m.settings.widths:
            m.filters[w], m.bias[w], q["f", w], q["b", w] = (next_like(x) for x in (m.filters[w], m.bias[w], q["f", w], q["b", w]))
        m.out, m.out_bias, q["o"], q["c"] = next_like(m.out), float(next_like(m.out_bias)), next_like(q["o"]), float(next_like(q["c"]))


def train(texts: Packed, labels: np.ndarray, s: Settings | None = None) -> Model:
    """Fit the network on texts that are at hand."""
    s = s or Settings()
    model = Model.start(s)
    if len(labels) == 0 or labels.min() == labels.max():
        model.constant = -20.0 if len(labels) == 0 or labels[0] == 0 else 20.0
        return model
    trainer, rng = Trainer(model, labels.mean()), np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        trainer.learn(texts, labels, rng.permutation(len(labels)))
    return model


def calibrate(model: Model, texts: Packed, labels: np.ndarray, least: int = 10) -> None:
    """Thresholds on the logit by guessed language, and one (-1) over all for languages with few rows of a class."""
    if model.constant is not None or not len(labels):
        return
    rows = np.arange(len(texts))
    logit = np.concatenate([model.logits(texts.take(rows[k:k + TEXTS_AT_ONCE])) for k in range(0, len(rows), TEXTS_AT_ONCE)])
    language = texts.languages
    model.thresholds[-1] = best_threshold(logit, labels)
    for k in range(len(LANGUAGES)):
        own = language == k
        if min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= least:
            model.thresholds[k] = best_threshold(logit[own], labels[own])


def best_threshold(logit: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The cut with fewest weighted errors (both classes weigh the same), in the middle of its gap; ties: the widest gap.

    ``counts`` says how many rows each value stands for.
    """
    if not len(labels) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(logit, kind="stable")
    n = np.ones(len(order)) if counts is None else counts[order].astype(np.float64)
    x, y = logit[order].astype(np.float64), labels[order]
    positives, negatives = (n * y).sum(), (n * (1 - y)).sum()
    below = np.concatenate([[0], np.cumsum(n * y)]) / positives
    above = 1 - np.concatenate([[0], np.cumsum(n * (1 - y))]) / negatives
    edges = np.concatenate([[x[0] - 2], x, [x[-1] + 2]])
    gap = np.diff(edges)
    cost = np.where(gap > 0, below + above, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = best[np.argmax(gap[best])]
    return float((edges[at] + edges[at + 1]) / 2)


# ---------------------------------------------------------------- Spark

def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    sample_chars: int | None = None, settings: Settings | None = None, shard_rows: int = SHARD_ROWS,
) -> Model:
    """Fit and calibrate on all labelled rows and their whole texts.

    Held-out rows (remainder 0 of crc32 modulo 5) take no part; remainder 1 calibrates, the others train. Null labels, ids and
    texts take no part either, equal texts count once, under their smallest hash of an id. Shards are made of the tasks that read the texts, about ``shard_rows`` each;
    an epoch starts every shard from the same model and averages what they changed, a bucket of the embedding over the shards that have
    its words. Without rows of both classes the score is constant. ``sample_chars``, if a caller sets it, passes over
    longer texts. A null id is neither held out nor learnt from: ``held_out`` is false there.
    """
    s = settings or Settings()
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    chosen = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(
        F.col(doc_id).alias("k")).agg(F.max(F.col(label)).alias("y"))
    rows = docs.filter(F.col(text).isNotNull() if sample_chars is None else F.length(text) <= sample_chars).select(
        F.col(doc_id).alias("k"), F.col(text).alias("t"), remainder.alias("r"), F.unhex(F.sha2(F.col(text), 256)).alias("same"))
    # without texts: one row of one id per text, and how many rows have that id and text
    known = rows.select("k", "r", "same").join(bounded_broadcast(chosen), "k").groupBy("k", "same").agg(
        F.min("r").alias("r"), F.max("y").alias("y"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.xxhash64("k").alias("h"), "k", "r", "y", "n")).alias("m")
    known = cut_lineage(known.groupBy("same").agg(first).select("m.k", "same", "m.r", "m.y", "m.n"))
    shards = max(1, -(-known.count() // shard_rows))

    def whole(part: DataFrame) -> DataFrame:
        return rows.select("k", "t", "same").join(bounded_broadcast(part.drop("n")), ["k", "same"])

    dealt, repeated = whole(known.filter("n = 1")), known.filter("n > 1")
    if not repeated.isEmpty():
        dealt = dealt.unionByName(whole(repeated).dropDuplicates(["k", "same"]))
    dealt = dealt.select("t", F.col("r").cast("bigint").alias("r"), (F.col("y") > 0).cast("bigint").alias("y"))
    texts = cut_lineage(dealt.mapInArrow(_packing(s), ", ".join(f"{c} binary" for c in _NUMPY) + ", r array<long>, y array<long>"))
    texts = texts.coalesce(shards)
    learnt = texts.select(F.explode(F.arrays_zip("r", "y")).alias("z")).filter("z.r <> 1").agg(
        F.count(F.lit(1)).alias("n"), F.sum("z.y").alias("toxic")).first()
    model = Model.start(s)
    if not learnt.n or learnt.toxic in (0, learnt.n):
        model.constant = 20.0 if learnt.n and learnt.toxic else -20.0
        return model
    trainer = Trainer(model, learnt.toxic / learnt.n)
    for epoch in range(s.epochs):
        _epoch(trainer, texts, epoch)
    _calibrate(model, texts)
    return model


_NUMPY = {"hashes": np.uint64, "buckets": np.int32, "numbers": np.int32, "starts": np.int64, "languages": np.int64}


def _packing(s: Settings):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                got = pack(part.column(0), s)
                columns = [pa.array([getattr(got, c).astype(kind).tobytes()], pa.binary()) for c, kind in _NUMPY.items()]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())),
                                                  pa.array([part.column(2).to_pylist()], pa.list_(pa.int64()))], [*_NUMPY, "r", "y"])

    return packed


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Packed, np.ndarray, np.ndarray]]:
    """Packed texts with their remainders and labels, a few hundred at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            values = {c: np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in _NUMPY.items()}
            values["buckets"] = values["buckets"].reshape(len(values["hashes"]), -1)
            yield Packed(**values), np.array(batch.column("r")[k].as_py(), np.int64), np.array(batch.column("y")[k].as_py(), np.int64)


def _epoch(trainer: Trainer, texts: DataFrame, epoch: int) -> None:
    """One pass over all shards; ``trainer`` takes the mean of their changes."""
    shared = texts.sparkSession.sparkContext.broadcast(trainer)
    size, buckets = trainer.model.settings.size, trainer.model.settings.buckets

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = shared.value, copy.deepcopy(shared.value)
        rng, any_text = np.random.default_rng([own.model.settings.seed, epoch]), False
        for packed, r, y in _unpacked(batches):
            any_text |= bool((r != 1).any())
            own.learn(packed, y, rng.permutation(np.flatnonzero(r != 1)))
        if not any_text:
            return
        change = np.column_stack([own.model.embedding - before.model.embedding, own.square["e"] - before.square["e"]])
        for k in range(0, buckets, BLOCK_BUCKETS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([change[k:k + BLOCK_BUCKETS].astype(np.float32).tobytes()], pa.binary())], ["block", "change"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([(own.small() - before.small()).tobytes()], pa.binary())], ["block", "change"])

    def mean(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            for value in batch.column("change"):
                if key[0].as_py() < 0:
                    row, seen = np.frombuffer(value.as_py()), 1
                else:
                    row = np.frombuffer(value.as_py(), np.float32).reshape(-1, size + 1).astype(np.float64)
                    seen = row[:, -1:] > 0  # the words of a bucket raise its squares
                total, n = total + row, n + np.asarray(seen, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.ravel(total / np.maximum(n, 1)).tobytes()], pa.binary())], ["block", "change"])

    schema = "block int, change binary"
    for row in texts.mapInArrow(learn, schema).groupBy("block").applyInArrow(mean, schema).collect():
        change = np.frombuffer(row.change)
        if row.block < 0:
            trainer.set_small(trainer.small() + change)
        else:
            part = slice(row.block, row.block + BLOCK_BUCKETS)
            change = change.reshape(-1, size + 1).astype(np.float32)
            trainer.model.embedding[part] += change[:, :-1]
            trainer.square["e"][part] += change[:, -1]
    shared.unpersist()


def _calibrate(model: Model, texts: DataFrame, least: int = 10) -> None:
    """``calibrate`` on counts of all calibration rows by language, label and logit in steps."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed, r, y in _unpacked(batches):
            own = np.flatnonzero(r == 1)
            if len(own):
                steps = np.floor(np.clip(shared.value.logits(packed.take(own)).astype(np.float64), -40, 40) * LOGIT_STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(packed.languages[own]), pa.array(y[own]), pa.array(steps)], ["language", "y", "step"])

    counted = texts.mapInArrow(count, "language long, y long, step long").groupBy("language", "y", "step").agg(F.count(F.lit(1)).alias("n"))
    found = np.array([tuple(r) for r in counted.orderBy("step", "y", "language").collect()], np.int64).reshape(-1, 4)
    logit = (found[:, 2] + 0.5) / LOGIT_STEPS
    model.thresholds[-1] = best_threshold(logit, found[:, 1], found[:, 3])
    for k in range(len(LANGUAGES)):
        own = found[:, 0] == k
        if min(found[own & (found[:, 1] == y), 3].sum() for y in (0, 1)) >= least:
            model.thresholds[k] = best_threshold(logit[own], found[own, 1], found[own, 3])


def score_column(text: Column, model) -> Column:
    """Score from 0 to 1 of whole texts; ``model`` is a Spark broadcast of a Model."""

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            for part in slices(texts, TEXTS_AT_ONCE):
                yield pa.array(model.value.scores(part), pa.float64())

    return scored(text)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of the whole text in ``out``.

    Null and empty texts score like a text without words; equal texts score alike; other columns pass through and
    are no inputs; texts of any length are read whole, in pieces that overlap by the widest filter. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(out, score_column(F.col(text), shared))


def describe(model: Model) -> str:
    """Thresholds by language, as JSON."""
    return json.dumps({LANGUAGES[k] if k >= 0 else "any": round(v, 3) for k, v in model.thresholds.items()})
