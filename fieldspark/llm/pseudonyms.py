"""Format-preserving pseudonyms for numbers and dates in text, by keyed Feistel networks in SQL functions.

Candidates are found by one regular expression, validated by their own rule (checksum, calendar, number ranges) and
permuted inside the set of values of the same format, so that equal values stay equal and different ones stay different
across all documents:

* payment cards  - 13 to 19 digits with a valid Luhn digit: all other digits are permuted, the Luhn digit follows; in a run of
                   more numbers they begin and end at a space or dash,
* IBAN           - valid modulo 97, of its country's length where that is known: the digits of the account part are permuted, the check digits follow,
* dates          - yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy or mm/dd/yyyy in the calendar: the day is permuted within its 400-year
                   cycle of 146 097 = 189 * 773 days,
* US social security numbers - inside the ranges that are issued,
* IPv4 addresses - all four numbers up to 255,
* phone numbers  - with a country code: the digits after it are permuted,
* e-mail addresses - the digits of the local part are permuted.

A network works on pairs (l, r) below the radices (a, b): in turn l moves by a keyed digest of r modulo a, and r by
one of l modulo b. Any such move can be undone, so the whole is a permutation for any pair of radices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import free_name

ROUNDS = 8

# Formats of the candidates; repetitions are bounded, so that long texts cost linear time.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,6}"
#: Countries by the length of their IBANs after the first four characters.
IBAN_LENGTHS = {
    11: "NO", 12: "BE", 14: "DK FI FK FO GL NL SD", 15: "MK SI", 16: "AT BA EE KZ LT LU MN XK", 17: "CH HR LI LV",
    18: "BG BH CR DE GB GE IE ME RS VA", 19: "AE GI IL IQ OM SO TL", 20: "AD CZ ES MD PK RO SA SE SK TN VG", 21: "LY PT ST",
    22: "IS TR", 23: "BI DJ FR GR IT MC MR SM", 24: "AL AZ BY CY DO GT HN HU LB NI PL SV", 25: "BR EG PS QA UA", 26: "JO KW MU YE",
    27: "MT SC", 28: "LC", 29: "RU",
}
KNOWN_IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}" for n, c in IBAN_LENGTHS.items()) + ")"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DAY_DATE = r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ \-]?\(?[0-9]{2,4}\)?[ \-]?[0-9]{3,4}[ \-]?[0-9]{3,4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
#: Digits of a card in the order in which they are tried at one place; the common length first, then the longest.
CARD_LENGTHS = (16, 15, 19, 18, 17, 14, 13)
#: Cards as they are commonly written; one that is valid counts before any other reading of the digits around it.
WRITTEN_CARD = r"(?:[0-9]{4}[ \-]){3}[0-9]{4}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19}"
BEFORE, AFTER = r"(?<![A-Za-z0-9._%+\-])", r"(?![A-Za-z0-9])"
#: Words of digits and capitals, joined by single spaces or dashes, up to the next value of another format. Cards, IBANs, ISO dates
#: and social security numbers are looked for inside, at every word.
RUN = (r"(?=[A-Z0-9 \-]{10})(?:[A-Z]{2}[0-9]{2}[A-Z0-9]*+|[0-9]++)(?![A-Za-z0-9])"
       rf"(?:[ \-](?!(?:{EMAIL}|{DAY_DATE}|{IPV4}){AFTER})[A-Z0-9]++{AFTER})*+")
CANDIDATE = f"{BEFORE}(?:{EMAIL}|{PHONE}|{DAY_DATE}|{IPV4}|{RUN}){AFTER}"
#: One word with what separates it; the group holds what is read from its start.
WORD = r"(?:^|[ \-])(?=([A-Z0-9][A-Z0-9 \-]{0,59}))[A-Z0-9]++"

#: Days of the 400-year cycle that starts on FIRST_DAY, and its two factors.
FIRST_DAY, CYCLE, CYCLE_A, CYCLE_B = "1800-01-01", 146_097, 189, 773


def _digest(key: Column, tag: Column, turn: Column, half: Column) -> Column:
    """60 keyed bits of one half."""
    hashed = F.sha2(F.concat_ws("|", key, tag, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, tag: Column, rounds: int = ROUNDS) -> Column:
    """Struct (l, r): the permuted pair. ``a`` and ``b`` are at most 10^18."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(pair: Column, turn: Column) -> Column:
        moved_l = F.pmod(pair["l"] + F.pmod(_digest(key, tag, turn, pair["r"]), a), a)
        moved_r = F.pmod(pair["r"] + F.pmod(_digest(key, tag, turn, pair["l"]), b), b)
        odd = turn % 2 == 1
        return F.struct(F.when(odd, moved_l).otherwise(pair["l"]).alias("l"), F.when(odd, pair["r"]).otherwise(moved_r).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _tens(n: Column) -> Column:
    return F.pow(F.lit(10).cast("decimal(20,0)"), n).cast("bigint")


def permute_digits(digits: Column, key: Column, tag: Column) -> Column:
    """A digit string of the same length; lengths from 2 to 36, others stay."""

    def spread(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")
        rest = F.length(d) - half
        pair = feistel(d.substr(F.lit(1), half), d.substr(half + 1, rest), _tens(half), _tens(rest), key,
                       F.concat_ws("|", tag, F.length(d).cast("string")))
        return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))

    return F.when(F.length(digits).between(2, 36), _let(digits, spread)).otherwise(digits)


def fill_digits(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``."""
    chars = F.split(template, "")

    def place(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        taken = digits.substr(state["n"] + 1, F.lit(1))
        return F.struct(
            F.concat(state["s"], F.when(is_digit, taken).otherwise(c)).alias("s"), (state["n"] + F.when(is_digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), place, lambda x: x["s"])


# ---------------------------------------------------------------- validation

def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, starting with position ``doubled_from`` (0: last)."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(
        i % 2 == doubled_from, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)
    ).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _luhn(text: Column) -> Column:
    return F.pmod(luhn_sum(_digits(text), 1), F.lit(10)) == 0


def luhn_digit(payload: Column) -> Column:
    return F.pmod(-luhn_sum(payload, 0), F.lit(10)).cast("string")


def iban_rest(iban: Column) -> Column:
    """The IBAN without spaces, its first four characters last, as a number modulo 97."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.when(
        c.rlike("^[0-9]$"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _date(text: Column) -> Column:
    """The day, or null outside the calendar and the 400-year cycle. dd/mm/yyyy counts before mm/dd/yyyy."""

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd")

    two, five, year = F.substring(text, 1, 2), F.substring(text, 4, 2), F.substring(text, 7, 4)
    iso = made(F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2))
    day = F.when(text.rlike(f"^{ISO_DATE}$"), iso).when(
        F.substring(text, 3, 1) == "/", F.coalesce(made(year, five, two), made(year, two, five))).otherwise(made(year, five, two))
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((number >= 0) & (number < CYCLE), number)


def _date_format(text: Column) -> Column:
    day_first = F.try_to_date(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)), "yyyy-MM-dd")
    return F.when(text.rlike(f"^{ISO_DATE}$"), "iso").when(F.substring(text, 3, 1) == ".", "dots").when(
        day_first.isNotNull(), "day").otherwise("month")


# ---------------------------------------------------------------- one pseudonym per kind

def _card(text: Column, key: Column) -> Column:
    digits = _digits(text)
    payload = F.substring(digits, 1, 18).substr(F.lit(1), F.length(digits) - 1)
    new = _let(permute_digits(payload, key, F.lit("card")), lambda p: F.concat(p, luhn_digit(p)))
    return F.when(_luhn(text), fill_digits(text, new))


def _iban(text: Column, key: Column) -> Column:
    def changed(plain: Column) -> Column:
        account = F.substr(plain, F.lit(5))
        number = permute_digits(_digits(account), key, F.concat(F.lit("iban"), F.substring(plain, 1, 2)))
        moved = fill_digits(account, number)
        check = _let(moved, lambda m: 98 - iban_rest(F.concat(F.substring(plain, 1, 2), F.lit("00"), m)))
        new = F.concat(F.lpad(check.cast("string"), 2, "0"), number)
        return F.when((iban_rest(plain) == 1) & F.length(plain).between(15, 34), fill_digits(text, new))

    return _let(F.replace(text, F.lit(" "), F.lit("")), changed)


def _day(text: Column, key: Column) -> Column:
    def moved(number: Column) -> Column:
        pair = feistel(F.floor(number / CYCLE_B), F.pmod(number, F.lit(CYCLE_B)), F.lit(CYCLE_A), F.lit(CYCLE_B), key, F.lit("date"))
        return _let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * CYCLE_B + p["r"]).cast("int")))

    def written(day: Column) -> Column:
        form = _date_format(text)
        return F.when(form == "iso", F.date_format(day, "yyyy-MM-dd")).when(form == "dots", F.date_format(day, "dd.MM.yyyy")).when(
            form == "day", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))

    number = _date(text)
    return F.when(number.isNotNull(), _let(_let(F.coalesce(number, F.lit(0)), moved), written))


def _ssn(text: Column, key: Column) -> Column:
    area, group, serial = (F.substring(text, p, n).cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    issued = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    new = _let(pair, lambda p: F.concat_ws(
        "-", F.lpad((p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0")))
    return F.when(issued, new)


def _ipv4(text: Column, key: Column) -> Column:
    parts = F.transform(F.split(text, "[.]"), lambda c: c.cast("int"))
    pair = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
    new = _let(pair, lambda p: F.concat_ws(".", *[v.cast("string") for h in "lr" for v in (F.floor(p[h] / 256), p[h] % 256)]))
    return F.when(F.forall(parts, lambda v: v <= 255), new)


def _phone(text: Column, key: Column) -> Column:
    code = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ \-(])", 0)
    code = F.when(code == "", F.substring(text, 1, 3)).otherwise(code)
    rest = text.substr(F.length(code) + 1, F.length(text))
    new = permute_digits(_digits(rest), key, F.concat(F.lit("phone"), code))
    return F.concat(code, fill_digits(rest, new))


def _email(text: Column, key: Column) -> Column:
    local = F.substring_index(text, "@", 1)
    digits = _digits(local)
    one = F.pmod(digits.cast("int") + F.pmod(_digest(key, F.lit("email1"), F.lit(0), F.lit(0)), F.lit(9)) + 1, F.lit(10)).cast("string")
    new = F.when(F.length(digits) == 1, one).otherwise(permute_digits(digits, key, F.lit("email")))
    return F.when(digits != "", F.concat(fill_digits(local, new), text.substr(F.length(local) + 1, F.length(text))))


#: Kinds that are tried on a whole candidate, in this order.
KINDS: dict[str, tuple[str, Callable[[Column, Column], Column]]] = {
    "email": (EMAIL, _email), "phone": (PHONE, _phone), "date": (DAY_DATE, _day), "ipv4": (IPV4, _ipv4),
}


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _first(texts: list[Column], make: Callable[[Column, Column], Column], valid: Callable[[Column], Column], key: Column) -> Column:
    """What ``make`` gives for the first valid text that is not empty; null if there is none."""
    return _let(F.get(F.filter(F.array(*texts), lambda t: (t != "") & valid(t)), F.lit(0)), lambda t: F.when(
        t.isNotNull(), F.struct(t.alias("old"), make(t, key).alias("new"))))


def _word(token: Column, ahead: Column, key: Column) -> Column:
    """Struct (kind, old, new) of the value that starts at a word of a run; null if none does."""

    def head(pattern: str) -> Column:
        return F.regexp_extract(ahead, f"^(?:{pattern}){AFTER}", 0)

    def of(kind: str, found: Column) -> Column:
        return _let(found, lambda v: F.when(v["new"].isNotNull(), F.struct(
            F.lit(kind).alias("kind"), v["old"].alias("old"), v["new"].alias("new"))))

    own = ~token.startswith("-")  # dates and social security numbers do not go on from a dash
    dated = of("date", _first([head(ISO_DATE)], _day, lambda t: _date(t).isNotNull(), key))
    social = of("ssn", _first([head(SSN)], _ssn, lambda t: F.lit(True), key))
    # A card ends before a date or social security number that follows it, and before a valid card as commonly written.
    alone = F.regexp_extract(ahead, f"^(.*?)(?: (?:{ISO_DATE}|{SSN}){AFTER}|$)", 1)
    later = F.get(F.filter(F.regexp_extract_all(alone, F.lit(f"[ \\-](?=((?:{WRITTEN_CARD}){AFTER}))"), F.lit(1)), _luhn), F.lit(0))
    short = _let(later, lambda c: F.when(c.isNull(), alone).otherwise(alone.substr(F.lit(1), F.instr(alone, c) - 2)))
    cards = [F.regexp_extract(short, rf"^[0-9](?:[ \-]?[0-9]){{{n - 1}}}{AFTER}", 0) for n in CARD_LENGTHS]
    card = of("card", _first([F.regexp_extract(alone, f"^(?:{WRITTEN_CARD}){AFTER}", 0), *cards], _card, _luhn, key))
    # An IBAN has its country's length; where that is not known, every end is tried, the longest first.
    strange = f"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})"
    ends = [f"{strange}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{tail}" for n in range(7, 1, -1) for tail in ("(?: ?[A-Z0-9]{1,3})", "")]
    iban = of("iban", _first([head(KNOWN_IBAN), head(IBAN), *map(head, ends)], _iban, lambda t: iban_rest(F.replace(t, F.lit(" "), F.lit(""))) == 1, key))
    return F.when(ahead.rlike("^[A-Z]{2}[0-9]{2}"), iban).when(
        ahead.rlike("^[0-9]"), F.coalesce(F.when(own, dated), F.when(own, social), card))


def _run(run: Column, key: Column) -> Column:
    """Array of (kind, value): the words of a run from left to right, each valid value as one."""
    words = F.arrays_zip(F.regexp_extract_all(run, F.lit(WORD), F.lit(0)).alias("token"), F.regexp_extract_all(run, F.lit(WORD), F.lit(1)).alias("ahead"))
    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<kind:string,value:string>>").alias("out"))

    def step(state: Column, word: Column) -> Column:
        def added(found: Column) -> Column:
            before = F.regexp_extract(word["token"], "^[ \\-]?", 0)
            value = F.when(found.isNull(), word["token"]).otherwise(F.concat(before, found["new"]))
            return F.struct(
                F.when(found.isNull(), 0).otherwise(F.size(F.split(found["old"], "[ \\-]")) - 1).alias("skip"),
                F.concat(state["out"], F.array(F.struct(found["kind"].alias("kind"), value.alias("value")))).alias("out"))

        return F.when(state["skip"] > 0, F.struct((state["skip"] - 1).alias("skip"), state["out"].alias("out"))).otherwise(
            _let(_word(word["token"], word["ahead"], key), added))

    return F.aggregate(words, start, step, lambda state: state["out"])


def pseudonym(candidate: Column, key: Column) -> Column:
    """Array of structs (kind, value) that replace the candidate: kind is null and the value unchanged where nothing is valid."""
    tried = [F.when(candidate.rlike(f"^(?:{pattern})$"), _let(make(candidate, key), _named(kind))) for kind, (pattern, make) in KINDS.items()]
    whole = F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), candidate.alias("value")))
    return F.when(candidate.rlike(f"^(?:{RUN})$"), _run(candidate, key)).otherwise(F.array(whole))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", out: str = "masked", kinds: str = "kinds") -> DataFrame:
    """``docs`` with the text in ``out``, its validated numbers and dates replaced by pseudonyms, and their ``kinds`` in order.

    Null stays null with no kinds; texts without candidates stay as they are; equal values have equal pseudonyms in every
    document and kind; repeated rows are treated alike; other columns pass through. Only SQL functions, no shuffle.
    """
    source, secret = F.col(text), F.lit(key)
    found = F.regexp_extract_all(source, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(source, CANDIDATE, -1)
    new = free_name(docs, "pseudonyms")
    none = F.array().cast("array<string>")
    staged = docs.withColumn(new, F.transform(
        F.when(source.rlike("[0-9]"), found).otherwise(none), lambda c: pseudonym(c, secret)))
    woven = F.array_join(F.flatten(F.zip_with(
        gaps, F.col(new), lambda g, n: F.array(g, F.coalesce(F.array_join(n["value"], ""), F.lit(""))))), "")
    return staged.withColumn(out, F.when(F.size(new) > 0, woven).otherwise(source)).withColumn(
        kinds, F.filter(F.transform(F.flatten(new), lambda n: n["kind"]), lambda k: k.isNotNull())).drop(new)
