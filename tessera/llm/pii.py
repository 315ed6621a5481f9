"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by one regular expression, validated by their own rules (check digits, calendar,
octet ranges, reserved blocks) and permuted inside their format by a keyed Feistel network over a
pair of residues. Equal values get equal pseudonyms in every document and, since each network is a
permutation, different numbers and dates of one format stay different. Addresses are no numbers: they
get keyed names of 64 bits for either part. What fails its validation is left as it stands.

Kinds, their domain and what stays as it is:

======  =======================================================  ======================
kind    domain                                                   kept
======  =======================================================  ======================
card    13 to 19 digits with a valid Luhn digit, plain, in        first digit, separator
        groups of four, or 4-6-5
phone   +country (area) 3 digits 4 digits; national as            country, punctuation
        (ddd) ddd-dddd or ddd-ddd-dddd, where neither of the
        first two groups starts with 0 or 1
ip      four octets                                               dots
date    yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy that exist, and        order, separator
        mm/dd/yyyy where dd/mm/yyyy doesn't; 72,900 days from
        1900-01-01, or 328,329 days from 1000-01-01
ssn     ddd-dd-dddd outside the reserved blocks                   dashes
iban    country, check digits, 11 to 30 letters and digits,       country, letters, spaces
        remainder 1 modulo 97
email   any address; its local part and host become keyed names   top-level domain
======  =======================================================  ======================

The expression takes time in proportion to the text: repetitions without a bound are possessive and
tried from one place of a run alone, all others are bounded. A host has at most 127 labels of 63
characters, as the standard has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table

ROUNDS = 8
#: The key of the query over test data. It is public and protects nothing.
TEST_KEY = "test data only"
#: Domains of dates: the first day, and the root of the number of days.
DATES = (("1900-01-01", 270), ("1000-01-01", 573))

_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_GROUPED = [f"[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}{s}[0-9]{{4}}" for s in " -"] + [f"[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}}" for s in " -"]
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@(?:{_LABEL}\.){{1,126}}[A-Za-z]{{2,63}}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+(.-])(?:\([2-9][0-9]{2}\) ?[2-9][0-9]{2}-[0-9]{4}|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4})(?![0-9-])",
    "card": rf"(?<![0-9.+-])(?:{'|'.join(_GROUPED)}|[0-9]{{13,19}})(?![0-9]|[.-][0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What a text must hold for any of them.
HINT = r"[0-9]{3}|@|[0-9]\.[0-9]|[A-Z]{2}[0-9]{2}"


def _round(key: str, label: str, n: Column, value: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(label), n.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, label: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs (left mod a, right mod b)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(acc, n):
        even = n % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + _round(key, label, n, acc["r"]), a)).otherwise(acc["l"]).cast("long").alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + _round(key, label, n, acc["l"]), b)).cast("long").alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _long(n) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("long")


def _feistel_digits(key: str, label: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of each length."""
    n, h = F.length(digits), F.floor(F.length(digits) / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = feistel(key, label, F.substring(digits, F.lit(1), h).cast("long"), F.substring(digits, h + 1, n - h).cast("long"), ten(h), ten(n - h))
    return F.concat(F.lpad(out["l"].cast("string"), h, F.lit("0")), F.lpad(out["r"].cast("string"), n - h, F.lit("0")))


def luhn_digit(payload: Column) -> Column:
    """The digit that makes ``payload`` plus it a valid number."""
    n = F.length(payload)

    def add(total, i):
        d = F.substring(payload, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _into(mask: Column, made: Column) -> Column:
    """``mask`` with the characters of ``made`` in the place of its letters and digits."""

    def step(acc, i):
        c = F.substring(mask, i, F.lit(1))
        fixed = F.struct(F.concat(acc["text"], c).alias("text"), acc["next"].alias("next"))
        taken = F.struct(F.concat(acc["text"], F.substring(made, acc["next"], F.lit(1))).alias("text"), (acc["next"] + 1).alias("next"))
        return F.when(c.isin(*" -.()+"), fixed).otherwise(taken)

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.length(mask)), start, step, lambda acc: acc["text"])


def _card(key: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    n = F.length(digits)
    valid = F.substring(digits, n, F.lit(1)) == luhn_digit(F.substring(digits, F.lit(1), n - 1))
    body = F.concat(F.substring(digits, 1, 1), _feistel_digits(key, "card", F.substring(digits, F.lit(2), n - 2)))
    made = F.concat(body, luhn_digit(body))
    return F.when(valid, F.when(F.length(m) == n, made).otherwise(_into(m, made)))


def _phone(key: str, m: Column) -> Column:
    parts = r"^(\+[0-9]{1,3}?[ .-]?\(?)([0-9]{3})(\)?[ .-]?)([0-9]{3})([ .-]?)([0-9]{4})$"
    part = lambda i: F.regexp_extract(m, parts, i)
    ten = _feistel_digits(key, "phone", F.concat(part(2), part(4), part(6)))
    abroad = F.concat(part(1), F.substring(ten, 1, 3), part(3), F.substring(ten, 4, 3), part(5), F.substring(ten, 7, 4))
    digits = F.regexp_replace(m, "[^0-9]", "")
    area, exchange, line = (F.substring(digits, at, n).cast("int") for at, n in ((1, 3), (4, 3), (7, 4)))
    out = feistel(key, "national", (area - 200) * 800 + exchange - 200, line, _long(640_000), _long(10_000))
    national = F.concat((F.floor(out["l"] / 800) + 200).cast("string"), (out["l"] % 800 + 200).cast("string"), F.lpad(out["r"].cast("string"), 4, "0"))
    return F.when(m.startswith("+"), abroad).otherwise(_into(m, national))


def _rest_97(text: Column) -> Column:
    """The remainder modulo 97 of capitals and digits read as a number, A as 10 up to Z as 35."""

    def step(acc, i):
        c = F.ascii(F.substring(text, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    country, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat) - 4)
    valid = F.length(flat).between(15, 34) & (_rest_97(F.concat(account, F.substring(flat, 1, 4))) == 1)
    digits = F.regexp_replace(account, "[A-Z]", "")
    new = _feistel_digits(key, "iban", digits)

    def step(acc, i):  # digits are replaced, letters stay
        c = F.substring(account, i, F.lit(1))
        kept = F.struct(F.concat(acc["text"], c).alias("text"), acc["next"].alias("next"))
        put = F.struct(F.concat(acc["text"], F.substring(new, acc["next"], F.lit(1))).alias("text"), (acc["next"] + 1).alias("next"))
        return F.when(c >= "A", kept).otherwise(put)

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    made = F.aggregate(F.sequence(F.lit(1), F.length(account)), start, step, lambda acc: acc["text"])
    check = F.lpad((98 - _rest_97(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid & (F.length(digits) > 1), _into(m, F.concat(country, check, made)))


def _ip(key: str, m: Column) -> Column:
    o = [F.split(m, r"\.")[i].cast("int") for i in range(4)]
    out = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536))
    made = F.concat_ws(".", F.shiftright(out["l"], 8), out["l"] % 256, F.shiftright(out["r"], 8), out["r"] % 256)
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), made)


def _date(key: str, m: Column) -> Column:
    iso, sep = m.rlike("^[0-9]{4}-"), F.substring(m, 3, 1)
    two = lambda at: F.substring(m, at, 2)
    day_first = F.concat_ws("-", F.substring(m, 7, 4), two(4), two(1)).try_cast("date")
    month_first = F.when(sep == "/", F.concat_ws("-", F.substring(m, 7, 4), two(1), two(4)).try_cast("date"))
    on = F.when(iso, m.try_cast("date")).otherwise(F.coalesce(day_first, month_first))
    out = F.lit(None).cast("string")
    for start, root in reversed(DATES):
        day = F.datediff(on, F.lit(start).cast("date"))
        moved = feistel(key, f"date {start}", F.floor(day / root), day % root, _long(root), _long(root))
        new = F.date_add(F.lit(start).cast("date"), (moved["l"] * root + moved["r"]).cast("int")).cast("string")
        out = F.when(day.between(0, root * root - 1), new).otherwise(out)
    year, month, of_month = F.substring(out, 1, 4), F.substring(out, 6, 2), F.substring(out, 9, 2)
    return F.when(iso, out).when(day_first.isNotNull(), F.concat(of_month, sep, month, sep, year)).otherwise(F.concat(month, sep, of_month, sep, year))


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = area - 1 - (area > 666).cast("int")
    out = feistel(key, "ssn", rank * 99 + group - 1, serial - 1, _long(898 * 99), _long(9999))
    rank = (out["l"] / 99).cast("int")
    area = rank + 1 + (rank >= 665).cast("int")
    made = F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((out["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((out["r"] + 1).cast("string"), 4, "0"))
    return F.when(valid, made)


def _email(key: str, m: Column) -> Column:
    name = lambda label, x: F.substring(F.sha2(F.concat_ws(":", F.lit(key), F.lit(label), F.lower(x)).cast("binary"), 256), 1, 16)
    host = F.substring_index(m, "@", -1)
    return F.concat(F.lit("p"), name("local", m), F.lit("@h"), name("host", host), F.lit("."), F.substring_index(host, ".", -1))


MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "phone": _phone, "card": _card}


def pseudonym(key: str, match: Column) -> Column:
    """struct(kind, value) of the pseudonym of one match, null where the match is not valid."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, pattern in reversed(list(PATTERNS.items())):
        whole = f"^(?:{pattern})$"
        made = MAKERS[kind](key, match)
        out = F.when(match.rlike(whole), F.when(made.isNotNull(), F.struct(F.lit(kind).alias("kind"), made.alias("value")))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in its text, and a last column of the matches replaced.

    Whoever knows ``key`` can undo the permutations: it is a secret of the caller.

    That column, ``replaced``, is an array of struct(kind, original, pseudonym) in text order; it
    gets underscores until its name is free. A null text stays null and an empty one empty, both
    with an empty array; all other columns and repeated rows pass unchanged. Texts of any length are
    handled whole, in time proportional to their length; only those with a digit run, an at sign or
    the head of an account number are taken apart.
    """
    text = F.col(f"`{text_col}`")
    out, found, made = fresh(docs, "replaced"), fresh(docs, "pii_found"), fresh(docs, "pii_made")
    maybe = text.isNotNull() & text.rlike(HINT)
    none = F.array().cast("array<string>")
    seen = docs.withColumn(found, F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    seen = seen.withColumn(made, F.transform(F.col(found), lambda m: pseudonym(key, m)))
    # array against array: an element that is looked up by its place would make the whole array anew
    chosen = F.zip_with(F.col(made), F.col(found), lambda x, m: F.coalesce(x["value"], m))
    put = F.zip_with(F.split(text, ANY, -1), F.concat(chosen, F.array(F.lit(""))), lambda p, c: F.concat(p, c))
    listed = F.filter(
        F.zip_with(
            F.col(made), F.col(found), lambda x, m: F.struct(x["kind"].alias("kind"), m.alias("original"), x["value"].alias("pseudonym"))
        ),
        lambda x: x["kind"].isNotNull(),
    )
    new = F.when(F.size(found) > 0, F.array_join(put, "")).otherwise(text)
    return seen.select(
        *[(new.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], listed.alias(out)
    )


def op10_pseudonymise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: the text with pseudonyms, and how many values of each kind were replaced."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY)

    def count(kind: str) -> Column:
        return F.size(F.filter("replaced", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in PATTERNS]
    return out.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"), *counts)
