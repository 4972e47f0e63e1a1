"""WARC archives by exact round trip, phrases and conversation repair against plain versions."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import phrases, queries, repair, warc

PAGES = "page_id long, url string, html string"


# ---------------------------------------------------------------- archives

def _pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumns({"key": F.lit("x"), "sha": F.lit(1), "type": F.lit(0), "n": F.lit(2)})


def test_archives_round_trip(spark, tmp_path):
    """Segments over many archives; payloads that hold record starts, chunk ends and half characters."""
    rng = random.Random(4)
    texts = ["", "a", "\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40, "\r\n\r\n" * 300, "0\r\n\r\n" * 200, "é\U0001f600" * 2000,
             "WARC/1.0", *("".join(rng.choices("ab\r\n", k=rng.randrange(4000))) for _ in range(60))]
    df = _pages(spark, [(k, f"http://h/{k}\r\nx", t) for k, t in enumerate(texts)]).repartition(5)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, segment_bytes=100, chunk_bytes=33, records_per_file=7)
    got = {r.key: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(texts) and not any(r.damage for r in got.values())
    for k, t in enumerate(texts):
        assert bytes(got[k].payload) == t.encode() and got[k].type == "response"
        assert got[k].payload_digest == got[k].stated_digest == warc.digest_of(t.encode())
        assert got[k].uri == f"http://h/{k}%0D%0Ax"


def test_archives_revisits_and_odd_rows(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, None, "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""),
            (None, "u", "only"), (None, "u", "only"), (5, "u", "x" * 100_000), (6, "u", "x" * 100_000)]
    path = str(tmp_path / "w")
    warc.write_archives(_pages(spark, rows), path)
    found = warc.resolve_revisits(warc.read_archives(spark, path, payload=False))
    got = Counter((r.key, r.payload_bytes, r.type, r.refers_to, r.damage) for r in found.collect())
    assert got == Counter([
        (1, 4, "revisit", 2, None), (2, 4, "response", None, None), (2, 4, "response", None, None), (None, 4, "revisit", 2, None),
        (3, 0, "revisit", 4, None), (4, 0, "response", None, None), (None, 4, "response", None, None), (None, 4, "response", None, None),
        (5, 100_000, "revisit", 6, None), (6, 100_000, "response", None, None)])
    small = str(tmp_path / "min")
    warc.write_archives(_pages(spark, rows), small, min_bytes=5)
    kinds = {r.key: r.type for r in warc.read_archives(spark, small).collect()}
    assert kinds[1] == kinds[3] == "response" and kinds[5] == "revisit"
    empty = str(tmp_path / "none")
    warc.write_archives(_pages(spark, rows).limit(0), empty)
    assert warc.resolve_revisits(warc.read_archives(spark, empty)).count() == 0


def _archive(*parts):
    return gzip.compress(b"".join(parts))


def test_damaged_archives(spark, tmp_path):
    """Each kind of damage is named, reading goes on behind it; segments come in any order and from any archive."""
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"

    def rec(kind, key, block, *more):
        return warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<{key}>"), ("Content-Type", "application/http"), *more], block)

    def first(key, block):
        return rec("response", key, block, ("WARC-Segment-Number", "1"), (warc.KEY, str(key)))

    def more(key, number, block, total=None):
        end = [("WARC-Segment-Total-Length", str(total))] if total else []
        return rec("continuation", f"{key}-{number}", block, ("WARC-Segment-Origin-ID", f"<{key}>"), ("WARC-Segment-Number", str(number)), *end)

    body = http + warc.chunked(b"hello world", 4)
    n = len(body)
    good = rec("response", 9, body, (warc.KEY, "9"))
    files = {
        "a": _archive(rec("warcinfo", "i", b"about"), more(1, 3, body[60:], n), b"junk\r\n", good, first(2, body[:30])),
        "b": _archive(more(1, 2, body[50:60]), first(1, body[:50]), more(1, 2, body[50:60]), more(2, 3, body[40:], n)),
        "c": _archive(first(3, body[:30]), more(3, 2, body[30:], n + 1), rec("response", 4, http + b"5\r\nhel", (warc.KEY, "4")),
                      rec("response", 5, body, (warc.KEY, "5"), ("WARC-Payload-Digest", "sha1:AAAA")),
                      rec("response", 6, b"no header", (warc.KEY, "6"))),
        "d": _archive(good.replace(b"Content-Length: ", b"Content-Length: 1"), good, rec("response", 7, body, (warc.KEY, "7"))[:-20]),
        "e": _archive(more(8, 2, b"x", 9)),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    got = Counter((r.key, r.payload_bytes, r.damage) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == Counter({
        (None, 5, None): 1, (1, 11, None): 1, (None, None, "not a record"): 1, (9, 11, None): 2, (2, None, "missing segment"): 1,
        (3, None, "wrong total length"): 1, (4, None, "broken framing"): 1, (5, None, "wrong digest"): 1, (6, None, "no HTTP header"): 1,
        (9, None, "wrong length"): 1, (7, None, "wrong length"): 1, (None, None, "missing segment"): 1})


def test_unchunked():
    assert warc.unchunked(warc.chunked(b"abc" * 99, 7)) == b"abc" * 99
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab\r\n0\r\n\r\n", b"-3\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"3\r\nabc\r\n0\r\n", b"zz\r\n"):
        assert warc.unchunked(bad) is None


# ---------------------------------------------------------------- phrases

def _phrases(docs, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i:i + m])) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    frequent = {k: f for k, f in counts.items() if f >= least}
    for (lang, w), a in frequent.items():
        if len(w) < 2 or any(g == lang and len(v) > len(w) and f >= a and any(v[i:i + len(w)] == w for i in range(len(v)))
                             for (g, v), f in frequent.items()):
            continue
        n = totals[lang]
        score, _, l, r = min((1000 * a * n // (l * r), k, l, r) for k in range(1, len(w))
                             for l, r in [(counts[lang, w[:k]], counts[lang, w[k:]])])
        out.append((lang, -score, -a, " ".join(w).encode(), l, r, n))
    out.sort()
    rank = Counter()
    rows = []
    for lang, s, a, w, l, r, n in out:
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], w.decode(), -a, l, r, n, -s))
    return rows


def _texts(seed):
    rng = random.Random(seed)
    words = ["new", "york", "city", "of", "the", "Ärger", "x y", "\x00", "NASA", "a"]
    out = []
    for _ in range(120):
        parts = rng.choices([*words, "new York", "in the city of", "ice cream cake with cherries", "stop. Go", "a,b", "tab\tbed", "\n"], k=rng.randrange(1, 60))
        out.append((rng.choice([" ", "  ", "\t "]).join(parts), rng.choice(["en", "en", "de", None])))
    return out + [("ice cream cake with cherries " * 40, "en"), (None, "en"), ("", "fr"), (" ,.\n", "fr"), ("a" * 5000, "fr"), ("same same", "fr")] + [("same same", "und")] * 6


@pytest.mark.parametrize(("period", "unit"), [(2, 1 << 20), (1, 400), (1000, 60)])
def test_phrases(spark, period, unit):
    """Equal to counting in the texts, whatever the chunks and the parts in which long texts are cut."""
    docs = _texts(period)
    df = spark.createDataFrame(docs, "text string, lang string").withColumns({c: F.lit(1) for c in ("phrase", "freq", "chunk", "h", "f", "n")})
    got = sorted(map(tuple, phrases.collocations(df, least=5, top=30, period=period, unit_bytes=unit).collect()))
    assert got == sorted(_phrases(docs, 5, 30)) and len(got) > 20
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrase_bits_let_all_through(spark, monkeypatch):
    """An array far too small for its phrases changes no count."""
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << phrases.BLOCK_BITS)
    docs = _texts(7)
    df = spark.createDataFrame(docs, "text string, lang string")
    got = sorted(map(tuple, phrases.collocations(df, least=3, top=None, period=4).collect()))
    assert got == sorted(_phrases(docs, 3, 10**9))


def test_phrase_contained_share(spark):
    df = spark.createDataFrame([("red hot pepper", "en")] * 8 + [("hot pepper", "en")] * 2, "text string, lang string")
    names = lambda share: {r.phrase for r in phrases.collocations(df, least=2, contained=share).collect()}
    assert names(100) == {"red hot pepper", "hot pepper"} and names(80) == {"red hot pepper"}


def test_parts_of_long_texts():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("ab \t.", [5, 5, 4, 1, rng.choice([0, 1])], k=rng.randrange(400))).encode()
        grams = Counter(tuple(w[i:i + 5]) for p in text.split(b".") for w in [p.split()] for i in range(len(w)))
        got = Counter()
        for part, extra in phrases.parts_of(text, 40):
            pieces = [p.split() for p in part.split(b".")]
            for k, w in enumerate(pieces):
                stop = len(w) - (extra if k == len(pieces) - 1 else 0)
                got.update(tuple(w[i:i + 5]) for i in range(stop))
        assert got == grams


# ---------------------------------------------------------------- conversations

def _cheapest(codes):
    """(cost, edits) over all edits, the first in ASCII order among equals."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}

    @lru_cache(None)
    def rest(i, q, inserted):
        options = [(0, "")] if i == len(codes) and q in (0, 3) else []

        def add(cost, edit, tail):
            if tail:
                options.append((cost + tail[0], edit + tail[1]))

        if inserted < 3:
            add(2, "I", rest(i, step[q], inserted + 1))
        if i < len(codes):
            initial, kind = divmod(codes[i], 3)
            add(3, "D", rest(i + 1, q, 0))
            if kind < 2:
                if (initial, q) in kept:
                    add(kind, "K", rest(i + 1, kept[initial, q], 0))
                add(2 + kind, "R", rest(i + 1, step[q], 0))
        return min(options, default=None)

    return rest(0, 0, 0)


def test_edits_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(3000):
        codes = [rng.randrange(12) for _ in range(rng.randrange(15))]
        assert repair.solve_row_codes(codes)[1:] == _cheapest(codes)


def _repaired(rows):
    """The contract, row by row."""
    out, groups = {}, {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, entries in groups.items():
        entries.sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1].encode(), e[2].encode()))
        turns = {e[0] for e in entries} - {None}
        seen, found = set(), []
        for _, role, text in entries:
            bare = text.strip(" \t\n\x0b\x0c\r")
            found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        codes = [3 * ("sua".find(e[1][0]) % 4 if e[1] else 3) + {"": 0, "truncated": 1}.get(f, 2) for e, f in zip(entries, found, strict=True)]
        cost, audit = _cheapest(codes)
        lines, state, at = [], "", 0
        for edit in audit:
            made = "assistant" if state.endswith("u") else "user"
            role, text = (made, "") if edit == "I" else entries[at][1:]
            at += edit != "I"
            if edit != "D":
                role = made if edit == "R" else role
                state += role[0]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", state)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(entries)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def _conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", "User", "unknown", None]
    texts = ["Hi.", "Why?", "no end", "No end. \n", " \t", "", None, "日本.", "Hi.", " "]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 100]), rng.choice(roles[:rng.choice([2, 3, 8])]), rng.choice(texts)))
    return rows + [(7, 3, "user", "Again.")] * 20


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most_rows", [4096, 3, 0])
def test_repair(spark, most_rows):
    """All conversations as arrays, the larger ones sorted over all tasks, and all of them so."""
    rows = _conversations()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "copies", "entries", "seq", "hot")})
    want = _repaired(rows)
    damaged = repair.damage(df)
    got = {r[0]: tuple(r[1:]) for r in repair.audit_conversations(damaged, most_rows).collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    lines = {}
    for r in sorted(repair.repaired_rows(damaged, most_rows).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert lines == {k: v[-1] for k, v in want.items() if v[-1]}
    assert repair.audit_conversations(repair.damage(df.limit(0)), most_rows).count() == 0


def test_repair_of_the_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = _repaired([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    rows = queries.op13_repair(spark, sf).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {k: v[:-1] for k, v in want.items()} and len(rows) == len(want)
