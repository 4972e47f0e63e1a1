"""Phrases whose words keep together, mined through a prefix-free parsing of the corpus.

Texts are cut into pieces at punctuation and pieces into chunks: a chunk starts where a piece starts or where the hash of
the next four words says so, and reaches four words into the next chunk of its piece. Content alone decides, so copied
passages give the same chunks. The distinct chunks with their frequencies form a dictionary, and everything is counted
there: a phrase of up to five words lies whole in the chunk in which it starts and counts once per occurrence of that
chunk, never in the overlap.

Counting goes length by length. Hashes of the phrases that reach the least frequency become a bit array of bounded size;
a longer phrase is counted only if both its ends are in the array of their length. The arrays can only let too many
through: frequencies are summed by the phrases' text at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import column_bytes, mix64, slices, store

#: Longest phrase in words; chunks overlap by one word less.
LONGEST = 5
OVERLAP = LONGEST - 1
#: One of so many four-word windows starts a chunk (mean).
PERIOD = 16
#: Bytes of text that are cut at once; longer pieces continue in another chunk.
UNIT_BYTES = 1 << 20
#: Bits of the array of one length: so many per phrase, and so many at most.
BITS_PER_PHRASE = 16
MOST_BITS = 1 << 27
BLOCK_BITS = 16

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
CLASS = np.zeros(256, np.uint8)
CLASS[list(BLANKS)] = 1
CLASS[list(BREAKS)] = 2
END_OF_WORD = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
NEXT_WORDS = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % OVERLAP)

NO_LANG = "und"


# ---------------------------------------------------------------- parsing

def parts_of(text: bytes, limit: int) -> Iterator[tuple[bytes, int]]:
    """``text`` in parts of about ``limit`` bytes, each with the number of its last words that belong to the next part."""
    at = 0
    while len(text) - at > limit:
        cut = max(text.rfind(b, at, at + limit) for b in (BREAKS[k:k + 1] for k in range(len(BREAKS))))
        if cut >= at:
            yield text[at:cut], 0
            at = cut + 1
            continue
        found = END_OF_WORD.search(text, at + limit)
        if not found:
            break
        ahead = NEXT_WORDS.match(text, found.start())
        yield text[at:ahead.end()], len(ahead[0].split())
        at = found.start()
    yield text[at:], 0


#: One random number per byte and per place; places beyond the last start again.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
PLACE = mix64(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def word_hashes(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each word; words lie one behind the other from ``offsets``."""
    if len(offsets) < 2:
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix64(np.add.reduceat(BYTE[values] * PLACE[place & 63], offsets[:-1]))


def numbered(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Dense numbers of the words, equal for equal words."""
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def next_hash(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + word)


def chunks_of(parts: list[tuple[bytes, int, str]], period: int) -> pa.RecordBatch:
    """Chunks (lang, chunk, starts) of texts; the words of a chunk end with a blank each, phrases start at its first words."""
    buf = np.frombuffer(b"\n".join([*(p.lower() for p, _, _ in parts), b""]), np.uint8)
    lengths = np.array([len(p) + 1 for p, _, _ in parts])
    kind = CLASS[buf]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(s)
    if not n:
        return pa.RecordBatch.from_pydict({"lang": [], "chunk": [], "starts": []}, schema=CHUNKS)
    piece = np.cumsum(kind == 2)[s]
    part = np.searchsorted(np.cumsum(lengths), s, "right")
    values = buf.copy()
    values[e] = 32
    inside[e] = True
    values = values[inside]
    offsets = np.concatenate([[0], np.cumsum(e - s + 1)])

    first = np.diff(piece, prepend=-1) != 0
    begins = first.copy()
    if n >= OVERLAP:
        word = word_hashes(offsets, values)
        window = word[:n - OVERLAP + 1]
        for k in range(1, OVERLAP):
            window = next_hash(window, word[k:n - OVERLAP + 1 + k])
        begins[:n - OVERLAP + 1] |= (mix64(window) % np.uint64(period) == 0) & (piece[:n - OVERLAP + 1] == piece[OVERLAP - 1:])
    start = np.flatnonzero(begins)
    stop = np.append(start[1:], n)
    ends_piece = np.append(first, True)[stop]
    # words at the end of a part that start phrases only in the next part
    own = np.searchsorted(part, np.arange(len(parts)), "right") - np.array([extra for _, extra, _ in parts])
    starts = np.minimum(stop, own[part[start]]) - start
    end = np.where(ends_piece, stop, stop + OVERLAP)
    some = starts > 0
    start, end, starts = start[some], end[some], starts[some]

    size = offsets[end] - offsets[start]
    to = np.concatenate([[0], np.cumsum(size)])
    text = values[np.arange(to[-1]) + np.repeat(offsets[start] - to[:-1], size)]
    chunk = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(text)])
    langs = pa.array([lang for _, _, lang in parts], pa.string()).take(pa.array(part[start]))
    return pa.RecordBatch.from_arrays([langs, chunk, pa.array(starts.astype(np.int32))], schema=CHUNKS)


CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("starts", pa.int32())])


def parse(docs: DataFrame, text: str, lang: str, period: int, unit_bytes: int) -> DataFrame:
    """The dictionary: distinct (lang, chunk, starts) with their frequency."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, str]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, 100):
                for value, name in zip(column_bytes(part.column(0)), part.column(1).to_pylist(), strict=True):
                    for piece, extra in parts_of(value, unit_bytes):
                        held.append((piece, extra, name))
                        size += len(piece) + 1
                        if size >= unit_bytes:
                            yield chunks_of(held, period)
                            held, size = [], 0
        if held:
            yield chunks_of(held, period)

    rows = docs.select(F.col(text).cast("string").alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    return rows.filter(F.col("t") != "").mapInArrow(cut, "lang string, chunk string, starts int").groupBy("lang", "chunk", "starts").agg(
        F.count(F.lit(1)).alias("freq"))


# ---------------------------------------------------------------- counting

class Bits:
    """A set of hashes in one bit array; may hold more than was put in."""

    def __init__(self, bits: int, blocks: list):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits >> 3, np.uint8)
        step = (1 << BLOCK_BITS) >> 3
        for block, data in blocks:
            self.words[block * step:(block + 1) * step] = np.frombuffer(data, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            out &= (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def bits_of(frequent: DataFrame) -> tuple[int, list]:
    """The bit array of the hashes ``h``, as blocks; MOST_BITS bound what the driver gets."""
    n = frequent.count()
    bits = 1 << max(BLOCK_BITS, min((n * BITS_PER_PHRASE - 1).bit_length() if n else 0, MOST_BITS.bit_length() - 1))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << BLOCK_BITS, np.uint8)
        block[rows["at"].to_numpy()] = 1
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [np.packbits(block, bitorder="little").tobytes()]})

    spots = frequent.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("v")).select(
        F.col("v").bitwiseAND(bits - 1).alias("p")).select(
        F.shiftright("p", BLOCK_BITS).alias("block"), F.col("p").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("at"))
    packed = spots.distinct().groupBy("block").applyInPandas(pack, "block long, data binary").collect()
    return bits, [(r["block"], bytes(r["data"])) for r in packed]


class Grams:
    """The phrases of a batch of dictionary rows, length by length."""

    def __init__(self, batch: pa.RecordBatch):
        langs, chunks, starts, freq = (batch.column(k) for k in range(4))
        if chunks.offset:
            chunks = pa.concat_arrays([chunks])
        at = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + len(chunks) + 1].astype(np.int64)
        self.values = np.frombuffer(chunks.buffers()[2], np.uint8)[at[0]:at[-1]]
        self.offsets = np.concatenate([[0], np.flatnonzero(self.values == 32) + 1])
        first = np.searchsorted(self.offsets, at - at[0])
        count = np.diff(first)
        names = langs.dictionary_encode()
        self.names = names.dictionary.to_pylist()
        lang = np.repeat(names.indices.to_numpy(zero_copy_only=False), count)
        salt = np.array([xxhash.xxh64_intdigest(x) for x in self.names], np.uint64)
        self.word = word_hashes(self.offsets, self.values)
        local = np.arange(len(self.word)) - np.repeat(first[:-1], count)
        self.left = np.repeat(count, count) - local
        self.weight = np.where(local < np.repeat(starts.to_numpy(), count), np.repeat(freq.to_numpy(), count), 0)
        self.lang = lang
        self.length = 1
        self.at = np.arange(len(self.word))
        self.hash = mix64(self.word ^ salt[lang]) if len(self.word) else self.word

    def keep(self, which: np.ndarray) -> None:
        self.at, self.hash = self.at[which], self.hash[which]

    def longer(self) -> None:
        """From the kept phrases to those one word longer whose two ends are both kept."""
        there = np.zeros(len(self.word) + 1, bool)
        there[self.at] = True
        self.length += 1
        self.keep(there[self.at + 1] & (self.left[self.at] >= self.length))
        self.hash = next_hash(self.hash, self.word[self.at + self.length - 1])


def hash_counts(dictionary: DataFrame, sets: list, length: int) -> DataFrame:
    """(h, f) of phrases of ``length`` words; ``sets`` holds the bit arrays of the shorter ones."""
    shared = dictionary.sparkSession.sparkContext.broadcast(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Bits(*s) for s in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = Grams(batch)
            for bits in known:
                grams.keep(bits.holds(grams.hash))
                grams.longer()
            grams.keep(grams.weight[grams.at] > 0)
            h, back = np.unique(grams.hash, return_inverse=True)
            f = np.zeros(len(h), np.int64)
            np.add.at(f, back, grams.weight[grams.at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f)], ["h", "f"])

    return dictionary.select("lang", "chunk", "starts", "freq").mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def text_counts(dictionary: DataFrame, sets: list) -> DataFrame:
    """(lang, words, phrase, f) of all phrases that the bit arrays let through, one row per text and batch."""
    shared = dictionary.sparkSession.sparkContext.broadcast(sets)
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Bits(*s) for s in shared.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = Grams(batch)
            # dense numbers of equal phrases, so that no hash decides what is equal
            number = np.zeros(len(grams.word) + 1, np.int64)
            word = numbered(grams.offsets, grams.values)
            vocabulary = int(word.max(initial=0)) + 1
            number[:-1] = word * len(grams.names) + grams.lang
            data = grams.values.tobytes()
            for length in range(1, LONGEST + 1):
                if length > 1:
                    grams.longer()
                    number[grams.at] = number[grams.at] * vocabulary + word[grams.at + length - 1]
                if length <= len(known):
                    grams.keep(known[length - 1].holds(grams.hash))
                _, sample, back = np.unique(number[grams.at], return_index=True, return_inverse=True)
                f = np.zeros(len(sample), np.int64)
                np.add.at(f, back, grams.weight[grams.at])
                number[grams.at] = back
                some = f > 0
                spot = grams.at[sample[some]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([grams.names[k] for k in grams.lang[spot]], pa.string()), pa.array(np.full(len(spot), length, np.int32)),
                    pa.array([data[a:b - 1].decode("utf-8", "surrogatepass") for a, b in zip(grams.offsets[spot], grams.offsets[spot + length], strict=True)],
                             pa.string()), pa.array(f[some])], schema=schema)

    return dictionary.select("lang", "chunk", "starts", "freq").mapInArrow(count, "lang string, words int, phrase string, f long")


def phrase_counts(dictionary: DataFrame, least: int) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of up to five words with f >= ``least``."""
    sets: list = []
    for length in range(1, LONGEST):
        frequent = store(hash_counts(dictionary, sets, length).filter(F.col("f") >= least).select("h"), f"phrase-hashes-{length}")
        sets.append(bits_of(frequent))
    return text_counts(dictionary, sets).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


# ---------------------------------------------------------------- scores

def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int | None = 2000, contained: int = 100,
    period: int = PERIOD, unit_bytes: int = UNIT_BYTES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to 5 words whose words keep together, best first.

    Within a language (null: ``und``), n is the number of words, a the phrase's frequency, and the phrase cut after k words
    has l and r as frequencies of its parts; its score is the lowest floor(1000 a n / (l r)) over the cuts (ties: the
    smallest k), in exact arithmetic. Phrases rarer than ``least`` are out, and so are those inside a longer one of
    up to five words that has at least ``contained`` percent of their frequency. ``top`` is the number of rows per language
    (None: all), by score and a descending, then by phrase in UTF-8 order.

    Null and empty texts hold no words. Repeated rows count each time. A text without punctuation or of any length is taken whole.
    Other columns are ignored. An empty table gives no rows.
    """
    dictionary = store(parse(docs, text, lang, period, unit_bytes), "phrase-dictionary")
    counts = store(phrase_counts(dictionary, least), "phrase-counts")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("freq") * F.col("starts")).alias("n"))
    several = counts.filter("words > 1")

    def with_words(name: str):
        return counts.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))

    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "words", "phrase", F.col("f").alias("a"), "k", F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    for part, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(with_words(name), (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))).drop("_lang", "_part", part)
    score = F.expr("CAST((CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(17,0)) * CAST(1000 AS DECIMAL(4,0)))"
                   " DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)")
    best = cuts.join(totals, "lang").groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # a phrase that is as frequent as a longer one around it also is as frequent as one just one word longer
    inner = several.filter("words > 2").select(
        "lang", "f", F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    if contained != 100:
        inner = _around(several)
    kept = best.join(inner, ["lang", "phrase"], "left").filter(
        F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(contained) * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _around(several: DataFrame) -> DataFrame:
    """The largest frequency of a longer phrase around each phrase, for any shorter length."""
    words = F.split("phrase", " ")
    spans = several.filter("words > 2").select(
        "lang", "f", words.alias("w"), "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m")
    ).select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    return spans.select("lang", "f", F.concat_ws(" ", F.expr("slice(w, i, m)")).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("f").alias("around"))
