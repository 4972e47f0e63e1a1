"""Repair of the order of roles in conversations, with block tables in the manner of the Four Russians.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Rows may be kept, given another role or deleted, and
empty rows inserted; the cheapest edits are found with four costs per row, one per state of that expression: what the
rest costs from there. Costs of neighbouring states differ by a constant at most, so that only a few cost vectors exist
apart from their offset. For each of them and each block of four row symbols a table holds the vector before the block and
the offset: conversations are read from their end, a block per lookup. The edits are then traced from the start; each
block is expanded once more from the vector behind it, and of equally cheap edits the first in ASCII order is taken,
which is safe because every choice is compared with the cost of all that follows.

Conversations of bounded size are one array each. Larger ones are sorted over all tasks by range, become one character per
row, and their texts are read again in order when they are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.scale import bounded_broadcast

from .tables import slices, store

#: Row symbols per block of the tables.
BLOCK = 4
#: Largest conversation that is handled as one array: rows, and characters of its texts.
ROWS = 4096
CHARS = 4 << 20

DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; the end is fine in 0 and 3.
NEXT = (2, 2, 3, 2)
MADE_ROLE = ("user", "user", "assistant", "user")
ENDS = (0, 3)
#: State after a kept row with initial s, u, a, another; -1: not allowed.
AFTER = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
FAR = 1 << 20

#: A row is one character: 3 * initial (s u a other) + (0 fine, 1 truncated, 2 must go), from "a" on.
SYMBOLS = 9
LEGAL = {(0, 1), (1, 2), (2, 1)}


# ---------------------------------------------------------------- tables

def closed(costs: list[int]) -> tuple[int, ...]:
    """Costs per state when rows may be inserted first."""
    for _ in costs:
        costs = [min(c, INSERT_COST + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def before_row(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs per state before a row, given those behind it; ``symbol`` is 2 * initial + truncated, or 8: must go."""
    costs = [DELETE_COST + c for c in after]
    if symbol < 8:
        initial, truncated = divmod(symbol, 2)
        for q in range(4):
            costs[q] = min(costs[q], REROLE_COST + truncated * TRUNCATED_COST + after[NEXT[q]])
            if AFTER[initial][q] >= 0:
                costs[q] = min(costs[q], truncated * TRUNCATED_COST + after[AFTER[initial][q]])
    return closed(costs)


class Tables:
    """All cost vectors (least cost 0), and for each of them the vector before a row and before a block, with offsets."""

    def __init__(self) -> None:
        self.end = closed([0 if q in ENDS else FAR for q in range(4)])
        self.vectors = [self.end]
        known = {self.end: 0}
        step: list[list[tuple[int, int]]] = []
        for v in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                costs = before_row(v, symbol)
                least = min(costs)
                costs = tuple(c - least for c in costs)
                if costs not in known:
                    known[costs] = len(self.vectors)
                    self.vectors.append(costs)
                row.append((known[costs], least))
            step.append(row)
        self.step = np.array(step)
        to, added = self.step[:, :, 0], self.step[:, :, 1]
        block_to, block_added = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        for _ in range(BLOCK):
            # one more symbol in front: vector before it, given the one before the symbols so far
            block_added = (block_added[:, None, :] + added[block_to].transpose(0, 2, 1)).reshape(len(step), -1)
            block_to = to[block_to].transpose(0, 2, 1).reshape(len(step), -1)
        self.block_to, self.block_added = block_to.tolist(), block_added.tolist()
        self.expand = lru_cache(maxsize=1 << 18)(self._expand)

    def _expand(self, symbols: tuple[int, ...], behind: int, state: int) -> tuple[str, int]:
        """Edits of a block entered in ``state``, and the state behind it; ``behind`` is the vector there."""
        vectors, offsets = [behind], []
        for symbol in reversed(symbols):
            to, added = self.step[vectors[-1], symbol]
            vectors.append(int(to))
            offsets.append(int(added))
        vectors.reverse()
        offsets.reverse()
        out = []
        for k, symbol in enumerate(symbols):
            here, there = self.vectors[vectors[k]], self.vectors[vectors[k + 1]]
            while True:
                left = here[state] + offsets[k]
                if DELETE_COST + there[state] == left:
                    out.append(DELETE)
                elif INSERT_COST + here[NEXT[state]] == here[state]:
                    out.append(INSERT)
                    state = NEXT[state]
                    continue
                else:
                    initial, truncated = divmod(symbol, 2)
                    kept = AFTER[initial][state]
                    if kept >= 0 and truncated * TRUNCATED_COST + there[kept] == left:
                        out.append(KEEP)
                        state = kept
                    else:
                        out.append(REROLE)
                        state = NEXT[state]
                break
        return "".join(out), state

    def solve(self, symbols: list[int]) -> tuple[int, str]:
        """Least cost and edits of a conversation."""
        n = len(symbols)
        blocks = [symbols[k:k + BLOCK] for k in range(0, n, BLOCK)]
        behind, cost = [0] * (len(blocks) + 1), 0
        for k in range(len(blocks) - 1, -1, -1):
            v = behind[k + 1]
            if len(blocks[k]) == BLOCK:
                at = 0
                for s in blocks[k]:
                    at = at * SYMBOLS + s
                behind[k], cost = self.block_to[v][at], cost + self.block_added[v][at]
            else:
                for s in reversed(blocks[k]):
                    v, added = self.step[v, s]
                    cost += int(added)
                behind[k] = int(v)
        cost += self.vectors[behind[0]][0]
        edits, state = [], 0
        for k, block in enumerate(blocks):
            done, state = self.expand(tuple(block), behind[k + 1], state)
            edits.append(done)
        while state not in ENDS:
            edits.append(INSERT)
            state = NEXT[state]
        return cost, "".join(edits)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


# ---------------------------------------------------------------- one conversation

def solve_row_codes(codes: list[int]) -> tuple[int, int, str]:
    """(illegal neighbours, cost, edits) of a conversation; a code is 3 * initial + (0 fine, 1 truncated, 2 must go)."""
    initials = [c // 3 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    cost, edits = tables().solve([8 if c % 3 == 2 else 2 * (c // 3) + c % 3 for c in codes])
    return illegal, cost, edits


class Mended:
    """Applies edits to rows in order; yields the repaired (role, text)."""

    def __init__(self, edits: str):
        self.edits = edits
        self.at = self.state = 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == INSERT:
            yield MADE_ROLE[self.state], ""
            self.state = NEXT[self.state]
            self.at += 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = AFTER["sua".index(role[0])][self.state]
            yield role, text
        elif edit == REROLE:
            yield MADE_ROLE[self.state], text
            self.state = NEXT[self.state]


class Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self) -> None:
        self.hash = hashlib.sha256()
        self.some = False

    def add(self, role: str, text: str) -> None:
        self.hash.update((b"\n" if self.some else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True


def code_of(role: str, fault: str | None) -> int:
    initial = "sua".find(role[:1]) if role else 3
    return 3 * (initial if initial >= 0 else 3) + (0 if fault is None else 1 if fault == "truncated" else 2)


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each row of a conversation: blank, duplicate, truncated, or None."""
    seen, out = set(), []
    for row in rows:
        text = row[1].rstrip(SPACE)
        out.append("blank" if not text else "duplicate" if row in seen else "truncated" if text[-1] not in ".!?" else None)
        seen.add(row)
    return out


def figures(entries: list[dict], lines_too: bool) -> dict:
    """The result for one conversation, given its rows (turn, role, text, copies) in order."""
    turns = {e["turn"] for e in entries} - {None}
    rows = [(e["role"], e["text"]) for e in entries for _ in range(e["copies"])]
    found = faults(rows)
    illegal, cost, edits = solve_row_codes([code_of(role, fault) for (role, _), fault in zip(rows, found, strict=True)])
    mended, digest, lines = Mended(edits), Digest(), []
    for role, text in [*(x for row in rows for x in mended.row(*row)), *mended.inserted()]:
        digest.add(role, text)
        if lines_too:
            lines.append({"role": role, "text": text})
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: found.count(k) for k in KINDS}, "illegal": illegal,
            "cost": cost, "audit": edits, "repaired_sha256": digest.hash.hexdigest(), "lines": lines}


KINDS = ("blank", "duplicate", "truncated")
FIGURES = [*((c, pa.int64()) for c in ("gaps", *KINDS, "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
LINES = ("lines", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
COLUMNS = [n for n, _ in FIGURES]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# ---------------------------------------------------------------- tables of conversations

def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): ``rows`` with faults put in by the checksum of ``conv:turn``; null texts and roles
    are one space, and so are nulls inside the checksum's input. Of 20 remainders, 0 drops a row (copies 0), 1 empties its text,
    2 takes its ends of sentences, 3 repeats it, 4 makes it the user's."""
    key = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def audit_conversations(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies): conv and the columns RESULT.

    Rows are taken by turn, nulls first, then by role and text; ``copies`` is how often a row is there. ``gaps`` counts
    turns missing between the first and the last (null turns are no turns), ``blank``, ``duplicate`` and ``truncated``
    the rows by their first fault, ``illegal`` the neighbours whose initials are not su, ua or au; ``cost`` and ``audit`` are
    the cheapest edits, ``repaired_sha256`` the digest of the repaired ``role:text`` lines. A conversation without rows has zeros,
    an empty audit and the digest of an empty text. A null conversation id is a conversation. Roles and texts must not
    be null (see ``damage``). An empty table gives no rows. Conversations over ``most_rows`` or ``most_chars`` give the
    same results in another way.
    """
    small, large = _by_size(rows, most_rows, most_chars)
    one = F.arrow_udf(_each(False), "struct<" + RESULT + ">")
    found = _arrays(small).select("conv", one("entries").alias("r")).select("conv", "r.*")
    return found if large is None else found.unionByName(_large_figures(large))


def repaired_rows(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """(conv, place, role, text): the repaired rows of every conversation, numbered from 0; arguments as before."""
    small, large = _by_size(rows, most_rows, most_chars)
    one = F.arrow_udf(_each(True), "struct<" + RESULT + ", lines array<struct<role:string,text:string>>>")
    found = _arrays(small).select("conv", one("entries")["lines"].alias("lines")).select(
        "conv", F.posexplode("lines").alias("place", "line")).select("conv", F.col("place").cast("bigint").alias("place"), "line.*")
    return found if large is None else found.unionByName(_large_rows(large))


def _by_size(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of bounded conversations, and those of larger ones or None."""
    size = F.sum("copies").alias("n"), F.sum(F.length("text") * F.col("copies")).alias("chars")
    hot = store(rows.groupBy("conv").agg(*size).filter((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(
        F.col("conv").alias("hot")), "large-conversations")
    if hot.isEmpty():
        return rows, None
    hot = bounded_broadcast(hot)
    same = F.col("conv").eqNullSafe(F.col("hot"))
    return rows.join(hot, same, "left_anti"), rows.join(hot, same, "left_semi")


def _arrays(rows: DataFrame) -> DataFrame:
    """(conv, entries in order); a conversation without rows has no entry."""
    entry = F.when(F.col("copies") > 0, F.struct("turn", "role", "text", "copies"))
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def _each(lines_too: bool):
    kind = pa.struct([*FIGURES, LINES] if lines_too else FIGURES)

    def one(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for entries in columns:
            for part in slices(entries, 200):
                out = [figures(e, lines_too) for e in part.to_pylist()]
                yield pa.array([{k: v for k, v in r.items() if lines_too or k != "lines"} for r in out], kind)

    def whole(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for entries in columns:
            yield pa.concat_arrays(list(one(iter([entries])))) if len(entries) else pa.array([], kind)

    whole.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return whole


# ---------------------------------------------------------------- large conversations

def _in_order(rows: DataFrame) -> DataFrame:
    """The rows of large conversations with their place ``seq`` in order over all tasks, their code and fault.

    Equal rows become one with a number of copies; what else may be frequent are rows of one role and text, of which only the
    first turn is asked for.
    """
    rows = rows.filter("copies > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("said", F.sha2("text", 256)).withColumn("when", F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    first = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("said").alias("s")).agg(F.min("when").alias("first"))
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = rows.withColumn("fault", F.when(end == "", "blank").when(F.col("when") != F.col("first"), "duplicate").when(
        ~end.isin(".", "!", "?"), "truncated"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role"]
    placed = rows.repartitionByRange(parts, *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text").select(
        "conv", "turn", "role", "text", "copies", "fault", F.monotonically_increasing_id().alias("seq"))
    return store(placed, "large-rows")


def _codes(placed: DataFrame) -> DataFrame:
    """(conv, codes): one character per row in order, put together from stretches."""
    def code(kind: int | Column) -> Column:
        initial = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
        return F.chr(F.lit(97) + 3 * initial + kind)

    own = code(F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", 1).otherwise(2))
    copies = F.concat(own, F.repeat(code(2), (F.col("copies") - 1).cast("int")))
    stretches = placed.groupBy("conv", F.shiftright("seq", 14).alias("stretch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", copies.alias("x")))), lambda e: e["x"]), "").alias("x"))
    return stretches.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "x"))), lambda e: e["x"]), "").alias("codes"))


def _solved(placed: DataFrame) -> DataFrame:
    """(conv, illegal, cost, audit) of large conversations."""
    kind = pa.struct([("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    @F.arrow_udf("struct<illegal:long,cost:long,audit:string>")
    def solve(codes: pa.Array) -> pa.Array:
        out = [solve_row_codes([ord(c) - 97 for c in row]) for row in codes.to_pylist()]
        return pa.array([dict(zip(("illegal", "cost", "audit"), r, strict=True)) for r in out], kind)

    return store(_codes(placed).select("conv", solve("codes").alias("r")).select("conv", "r.*"), "large-audits")


def _stream(placed: DataFrame, audits: DataFrame, digest: bool) -> DataFrame:
    """Texts of large conversations in order, behind their edits: repaired rows, or the digest of each conversation."""
    conv = placed.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, repaired_sha256 string" if digest else f"conv {conv}, place long, role string, text string"
    rows = placed.select("conv", "seq", "role", "text", "copies", F.lit(None).cast("string").alias("audit")).unionByName(
        audits.select("conv", F.lit(-1).cast("bigint").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"),
                      F.lit(0).cast("bigint").alias("copies"), "audit"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None  # conversation, edits, digest
        place = 0

        def batch_of(ids, types, out) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))],
                                              [x.split(" ")[0] for x in schema.split(", ")])

        types = [pa.string()] if digest else [pa.int64(), pa.string(), pa.string()]
        ids = None
        for batch in batches:
            ids = batch.schema.field("conv").type
            for part in slices(batch, 100):
                out: list[tuple] = []

                def take(pairs) -> None:
                    nonlocal place
                    for role, text in pairs:
                        if digest:
                            current[2].add(role, text)
                        else:
                            out.append((current[0], place, role, text))
                            place += 1

                for row in part.to_pylist():
                    if row["audit"] is not None:
                        if current:
                            take(current[1].inserted())
                            if digest:
                                out.append((current[0], current[2].hash.hexdigest()))
                        current, place = (row["conv"], Mended(row["audit"]), Digest()), 0
                    for _ in range(row["copies"]):
                        take(current[1].row(row["role"], row["text"]))
                if out:
                    yield batch_of(ids, types, out)
        if current:
            out = []
            take_rest = list(current[1].inserted())
            for k, (role, text) in enumerate(take_rest):
                if digest:
                    current[2].add(role, text)
                else:
                    out.append((current[0], place + k, role, text))
            if digest:
                out.append((current[0], current[2].hash.hexdigest()))
            if out:
                yield batch_of(ids, types, out)

    return rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "seq").mapInArrow(put_together, schema)


def _large_figures(rows: DataFrame) -> DataFrame:
    ids = rows.select("conv").distinct()
    placed = _in_order(rows)
    audits = _solved(placed)
    digests = _stream(placed, audits.select("conv", "audit"), True)
    repeated = F.col("copies") - 1
    counts = placed.groupBy("conv").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("copies")).when(F.col("fault") == "blank", 0).otherwise(repeated)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"))
    spans = placed.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    out = ids
    for k, part in enumerate((counts, spans, audits, digests)):
        part = part.withColumnRenamed("conv", f"conv{k}")
        out = out.join(part, F.col("conv").eqNullSafe(F.col(f"conv{k}")), "left").drop(f"conv{k}")
    return out.select("conv", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COLUMNS[:6]], "audit", "repaired_sha256")


def _large_rows(rows: DataFrame) -> DataFrame:
    placed = _in_order(rows)
    return _stream(placed, _solved(placed).select("conv", "audit"), False)
