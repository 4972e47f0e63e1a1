"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged across. Such pairs cut a
word into fragments that are encoded independently, by merging the best-ranked pair until none is left, and
concatenated.

The rules of the vocabulary file are kept: special tokens are taken out of the raw text first; the rest is
normalised (NFC, white space to spaces, lower case), split into words by the file's pattern, and the last byte of a word
carries the end-of-word suffix.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .tables import slices

#: Words and fragments remembered per task, so that memory stays bounded.
REMEMBERED = 100_000
#: A merge is one number, its rank above the token that it makes; no merge is larger than all.
TOKEN, NONE = 0xFFFFFFFF, 1 << 62
#: Characters on whose letters, digits and normal forms all Unicode versions in use agree. Words with
#: others are told apart by the vocabulary file's own rules as the tokenizers library reads them.
SETTLED = regex.compile(r"[\x00-\u0250\u0391-\u03a1\u03a3-\u03c9\u0400-\u0482\u0490-\u04ff\u2010-\u2027\u2030-\u205e\u20ac"
                        r"\u2190-\u21ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fcb\uac00-\ud7a3]*+").fullmatch


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks, the byte pairs that force a cut, and the rules before them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a plain BPE vocabulary is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): rank << 32 | self.ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.texts = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in (self.ids | self.special).items():
            self.texts[i] = t
        letters = byte_letters()
        self.byte_of = byte_of = {c: b for b, c in enumerate(letters)}
        self.path, self.rules = path, None
        self.joined = np.zeros((256, 256), bool)
        for token in self.ids:
            body = token.removesuffix(self.suffix) if self.suffix and token != self.suffix else token
            codes = [byte_of[c] for c in body]
            self.joined[codes[:-1], codes[1:]] = True
        self.inside = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.suffix] for c in letters]
        self.joins = [frozenset(np.flatnonzero(row).tolist()) for row in self.joined]
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, array] = {}

    # ------------------------------------------------------------ encoding

    def encode(self, text: str) -> array:
        out = array("i")
        parts = self.specials.split(text) if self.special and "<|" in text else (text,)
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                self._encode_plain(part, out)
        return out

    def _encode_plain(self, text: str, out: array) -> None:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if SETTLED(text):
            words = self.words(lower(unicodedata.normalize("NFC", text)))
        else:
            self.rules = self.rules or Tokenizer.from_file(self.path)
            parts = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
            words = [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogatepass") for w, _ in parts]
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = self._encode_word(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    known[word] = ids
            out.extend(ids)

    def fragments(self, word: bytes) -> Iterator[tuple[bytes, bool]]:
        """Pieces between forced cuts, and whether the piece ends the word."""
        joins, start = self.joins, 0
        for i, (a, b) in enumerate(zip(word, word[1:]), 1):
            if b not in joins[a]:
                yield word[start:i], False
                start = i
        yield word[start:], True

    def _encode_word(self, word: bytes) -> array:
        out = array("i")
        for piece, last in self.fragments(word):
            ids = [self.inside[b] for b in piece]
            if last:
                ids[-1] = self.last[piece[-1]]
            out.extend(merge_short(ids, self.ranks) if len(ids) <= 48 else merge_long(ids, self.ranks))
        return out

    # ------------------------------------------------------------ decoding

    def decode(self, ids) -> str:
        """Token texts joined by spaces: the file names no decoder."""
        return " ".join(map(self.texts.__getitem__, ids))


def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is an ordinary one."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def merge_short(ids: list[int], ranks: dict) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left."""
    found = [ranks.get(p, NONE) for p in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best == NONE:
            break
        at = found.index(best)
        ids[at:at + 2] = [best & TOKEN]
        del found[at]
        if at:
            found[at - 1] = ranks.get((ids[at - 1], ids[at]), NONE)
        if at < len(found):
            found[at] = ranks.get((ids[at], ids[at + 1]), NONE)
    return ids


def merge_long(ids: list[int], ranks: dict) -> list[int]:
    """The same with a heap and a linked list, for pieces of any length."""
    n = len(ids)
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = ranks.get((ids[i], ids[i + 1]))
        if found is not None:
            heap.append((found, i, ids[i], ids[i + 1]))
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        best, i, a, b = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i] = best & TOKEN
        gone[j] = 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n:
                found = ranks.get((ids[left], ids[right]))
                if found is not None:
                    heapq.heappush(heap, (found, left, ids[left], ids[right]))
    return [t for t, g in zip(ids, gone, strict=True) if not g]


# ---------------------------------------------------------------- columns

_held: dict[str, Vocabulary] = {}


def share(docs: DataFrame, path: str) -> str:
    """Ship the vocabulary file to the executors; its name there."""
    docs.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _vocabulary(name: str) -> Vocabulary:
    if name not in _held:
        _held[name] = Vocabulary(SparkFiles.get(name))
    return _held[name]


TOKENS = "struct<ids:array<int>,packed:binary,decoded:string>"


def tokens_column(text: Column, name: str) -> Column:
    """Struct TOKENS of a text column, by the shared vocabulary file ``name``; null is empty.

    Encoding and decoding share one function, so that a task holds one vocabulary.
    """

    @F.arrow_udf(TOKENS)
    def coded(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(name)
        for values in (part for column in texts for part in slices(column)):
            offsets, packed, decoded = [0], [], []
            for v in values:
                ids = vocabulary.encode(v.as_py() or "")
                offsets.append(offsets[-1] + len(ids))
                packed.append(np.frombuffer(ids, np.int32).astype("<u4").tobytes())
                decoded.append(vocabulary.decode(ids))
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            yield pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array(packed, pa.binary()),
                pa.array(decoded, pa.string()),
            ], names=["ids", "packed", "decoded"])

    return coded(text)


def tokenize(docs: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """``docs`` with a struct ``out``: ids of the whole text, the same packed as little-endian unsigned 32-bit integers,
    and the text they decode to.

    Null and empty texts have no ids and decode to an empty text; texts, words and fragments may have any length;
    repeated rows are encoded alike; other columns pass through. No shuffle.
    """
    return docs.withColumn(out, tokens_column(F.col(text), share(docs, path)))
