"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Validated numbers and dates (and e-mail addresses) are replaced by a keyed
permutation of the values of their format, so equal values get equal pseudonyms
in all documents, different ones different, and a pseudonym is valid where the
value was:

- card numbers (Luhn): the first digit stays, the check digit is made anew;
- IBANs (mod 97): the country stays, the check digits are made anew;
- social security numbers (ddd-dd-dddd): area (001-899 but 666), 01-99 and 0001-9999 are permuted together;
- North American phone numbers: digits that may not be 0 or 1 stay so;
- IPv4 addresses: the first octet stays (it tells private from public), the other 24 bits are permuted;
- dates (ISO, dd.mm.yyyy, mm/dd/yyyy) of the 73,200 days from 1900-01-01: permuted as days, so one date in two formats stays one;
- e-mail addresses: the domain stays; letters and digits before the @ keep their kind and are permuted under the domain.

Strings go through a Feistel network over characters: one half is shifted, each
character within its kind, by a keyed SHA-512 of the other half. Numbers and days
go through one over a grid of two moduli whose product is the number of values,
so no cycle walking is needed. All of it is one projection over whole texts: no
shuffle, no Python. The key is the caller's, without a default. Only its SHA-256
is in the plan, but that is as good as the key to who reads plan texts: set
``spark.sql.redaction.string.regex`` where these are kept.

All patterns are bounded (a domain has 126 labels at most), so the matcher's
stack is too.

Edge cases: null text stays null with no findings; empty text is kept; what looks
alike but is not valid stays as it is, and an empty key is refused; repeated values and rows get the same
pseudonyms; other columns are kept, but names that begin with two underscores
are the operator's own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a network (even), and characters that one SHA-512 shifts.
ROUNDS, SHIFTS = 8, 25
#: Days of the permuted range, as a grid.
DAY_GRID = (240, 305)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_MONTH, _DAY, _YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])", r"(?:19|20|21)[0-9]{2}"
_ISO, _DOTTED, _SLASHED = rf"{_YEAR}-{_MONTH}-{_DAY}", rf"{_DAY}\.{_MONTH}\.{_YEAR}", rf"{_MONTH}/{_DAY}/{_YEAR}"
_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,125}\.[A-Za-z]{2,24}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_PHONE = r"\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}"
_SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"
_CARD = r"[1-9][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}"
PATTERN = (
    rf"(?<![A-Za-z0-9._%+-]){_EMAIL}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9]){_IBAN}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9.])(?:{_IP}|{_DOTTED})(?![A-Za-z0-9])(?!\.[0-9])"
    rf"|(?<![A-Za-z0-9/-])(?:{_ISO}|{_SLASHED}|{_SSN})(?![A-Za-z0-9])(?![/-][0-9])"
    rf"|(?<![A-Za-z0-9]){_PHONE}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9-]){_CARD}(?![A-Za-z0-9])"
)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substr(s, i, F.lit(1)))


def grid_feistel(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (left < a, right < b)."""

    def keyed(i: Column, x: Column, modulus: int) -> Column:
        return _number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i, x), 256), 1, 14)) % modulus

    def step(state: Column, i: Column) -> Column:
        on_left = F.struct(((state["l"] + keyed(i, state["r"], a)) % a).alias("l"), state["r"].alias("r"))
        on_right = F.struct(state["l"].alias("l"), ((state["r"] + keyed(i, state["l"], b)) % b).alias("r"))
        return F.when(i % 2 == 0, on_left).otherwise(on_right)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def text_feistel(value: Column, mask: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of the strings of a mask, one for each kind: d digits, e digits from 2, a and A letters; else a character stays.

    A half has 50 characters at most to be shifted each by its own part of the hashes.
    """

    def shifted(s: Column, kinds: Column, by: Column) -> Column:
        def one(i: Column) -> Column:
            c, k = F.substr(s, i + 1, F.lit(1)), F.substr(kinds, i + 1, F.lit(1))
            n = _number(F.substr(by, F.floor(i / SHIFTS).cast("int") * 128 + (i % SHIFTS) * 5 + 1, F.lit(5))).cast("int")
            turned = lambda first, size: F.char((F.ascii(c) - first + n) % size + first)
            return F.when(k == "d", turned(48, 10)).when(k == "e", turned(50, 8)).when(k == "a", turned(97, 26)).when(k == "A", turned(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), one), "")

    def step(state: Column, i: Column) -> Column:
        part = lambda n: F.sha2(F.concat_ws("|", F.lit(key), kind, i, mask, F.lit(n), state["b"]), 512)
        by = F.when(F.length(state["a"]) > SHIFTS, F.concat(part(0), part(1))).otherwise(part(0))
        return F.struct(state["b"].alias("a"), shifted(state["a"], state["ka"], by).alias("b"), state["kb"].alias("ka"), state["ka"].alias("kb"))

    half = F.floor(F.length(value) / 2).cast("int")
    rest = lambda s: F.substr(s, half + 1)
    start = F.struct(F.left(value, half).alias("a"), rest(value).alias("b"), F.left(mask, half).alias("ka"), rest(mask).alias("kb"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return (total + d - F.when(d > 9, 9).otherwise(0)) % 10

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def mod97(text: Column) -> Column:
    """A string of digits and capitals (A is 10) as a number, modulo 97."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), add)


def _spread(shape: Column, symbols: Column, kinds: str) -> Column:
    """``symbols`` put, in order, where ``shape`` has characters of ``kinds``."""

    def add(state: Column, c: Column) -> Column:
        takes = c.rlike(kinds)
        symbol = F.substr(symbols, state["n"] + 1, F.lit(1))
        return F.struct(F.concat(state["s"], F.when(takes, symbol).otherwise(c)).alias("s"), (state["n"] + takes.cast("int")).alias("n"))

    return F.aggregate(_chars(shape), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), add, lambda s: s["s"])


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    n = F.length(digits)
    body = text_feistel(F.left(digits, n - 1), F.concat(F.lit("k"), F.repeat(F.lit("d"), n - 2)), key, F.lit("card"))

    def whole(body: Column) -> Column:
        return F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))

    new = F.element_at(F.transform(F.array(body), whole), 1)  # so that the body is evaluated once
    return F.when((n >= 13) & (n <= 19) & (luhn(digits) == 0), F.element_at(F.transform(F.array(new), lambda d: _spread(m, d, "[0-9]")), 1)).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body = F.substr(plain, F.lit(5))
    mask = F.translate(body, "0123456789" + _LETTERS.upper(), "d" * 10 + "A" * 26)

    def whole(new: Column) -> Column:
        check = 98 - mod97(F.concat(new, F.left(plain, F.lit(2)), F.lit("00")))
        return F.concat(F.left(plain, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), new)

    new = F.element_at(F.transform(F.array(text_feistel(body, mask, key, F.lit("iban"))), whole), 1)
    valid = (F.length(plain) >= 15) & (F.length(plain) <= 34) & (mod97(F.concat(body, F.left(plain, F.lit(4)))) == 1)
    return F.when(valid, F.element_at(F.transform(F.array(new), lambda s: _spread(m, s, "[A-Z0-9]")), 1)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area = F.left(m, F.lit(3)).cast("int")
    area = area - F.when(area > 666, 2).otherwise(1)
    new = grid_feistel(area, (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1, 898, 99 * 9999, key, "ssn")

    def written(s: Column) -> Column:
        part = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", part(s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), part(F.floor(s["r"] / 9999) + 1, 2), part(s["r"] % 9999 + 1, 4))

    return F.element_at(F.transform(F.array(new), written), 1)


def _phone(m: Column, key: str) -> Column:
    mask = F.regexp_replace(F.translate(m, "0123456789", "d" * 10), r"^(\+)d([^d]*)d(dd[^d]*)d", "$1k$2e$3e")
    return text_feistel(m, mask, key, F.lit("phone"))


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    bits = part(2) * 65536 + part(3) * 256 + part(4)
    new = grid_feistel(F.floor(bits / 4096), bits % 4096, 4096, 4096, key, "ip")
    octets = lambda x: F.concat_ws(".", F.split_part(m, F.lit("."), F.lit(1)), F.floor(x / 65536), F.floor(x / 256) % 256, x % 256)
    return F.element_at(F.transform(F.array(new), lambda s: octets(s["l"] * 4096 + s["r"])), 1)


def _date(m: Column, form: str, key: str) -> Column:
    a, b = DAY_GRID
    day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit("1900-01-01").cast("date"))
    new = grid_feistel(F.floor(day / b), day % b, a, b, key, "date")
    dated = lambda s: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * b + s["r"]).cast("int")), form)
    return F.when((day >= 0) & (day < a * b), F.element_at(F.transform(F.array(new), dated), 1)).otherwise(m)


def _email(m: Column, key: str) -> Column:
    local, domain = F.split_part(m, F.lit("@"), F.lit(1)), F.split_part(m, F.lit("@"), F.lit(2))
    mask = F.translate(local, _LETTERS + _LETTERS.upper() + "0123456789", "a" * 26 + "A" * 26 + "d" * 10)
    return F.concat(text_feistel(local, mask, key, F.concat(F.lit("email:"), F.lower(domain))), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match of PATTERN."""
    whole = lambda pattern: F.rlike(m, F.lit(rf"^(?:{pattern})$"))
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(F.rlike(m, F.lit("^[A-Z]")), _iban(m, key))
        .when(F.rlike(m, F.lit(r"^\+")), _phone(m, key))
        .when(whole(_IP), _ip(m, key))
        .when(whole(_DOTTED), _date(m, "dd.MM.yyyy", key))
        .when(whole(_ISO), _date(m, "yyyy-MM-dd", key))
        .when(whole(_SLASHED), _date(m, "MM/dd/yyyy", key))
        .when(whole(_SSN), _ssn(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts; adds n_found (matches) and n_replaced (those that were valid)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    key = hashlib.sha256(key.encode()).hexdigest()
    text = F.col(text_column)
    may = F.coalesce(F.rlike(text, F.lit("[0-9]{2}|@|[0-9]\\.[0-9]")), F.lit(False))
    found = F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumn("__found", found)
    docs = docs.withColumn("__new", F.when(F.size("__found") > 0, F.transform("__found", lambda m: F.coalesce(pseudonym(m, key), m))))
    between = F.split(text, PATTERN, -1)
    woven = F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get("__new", i), F.lit("")))), "")
    differ = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
    some = F.col("__new").isNotNull()
    docs = docs.withColumns({"n_found": F.size("__found").cast("long"), "n_replaced": F.when(some, differ).otherwise(0).cast("long")})
    return docs.withColumn(text_column, F.when(some, woven).otherwise(text)).drop("__found", "__new")


def digest(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found, n_replaced, text."""
    return pseudonymise(docs.select("doc_id", "text"), key).select("doc_id", "n_found", "n_replaced", "text")
