"""Personal data to format-preserving Feistel pseudonyms. DataFrame operations only.

Found are e-mail addresses, phone numbers, payment card numbers, IBANs, social security numbers, IPv4 addresses, dates and
labelled or recognisable secrets. Numbers and dates are validated (Luhn, mod 97, numbering plan, octets, calendar); what
fails is no such number and stays, except that an invalid phone number still counts as one of unknown plan. Each value is
permuted within its own format by a keyed Feistel network: equal values get equal pseudonyms in every document, different
values different ones, and only the key's holder can undo it. A card keeps its length and gets a new check digit, an IBAN
its country and new check digits, a North American number stays valid, a date stays a date of the calendar (within blocks
of 72,900 days from 1900 on), an address four octets. Other strings keep each character's class, digit, lower or upper
case letter, and all punctuation. Separators don't count: one number written two ways has one pseudonym in two forms.

A Feistel round changes one half by a number from a keyed SHA-256 of the other half, which is undone by subtraction, so
any number of rounds is a permutation. The halves are taken modulo the factors of the format's size, so nothing leaves it.

Patterns are bounded wherever a group repeats (a domain has 126 labels of 63 characters at most, as DNS has it; what is
longer is no address), so no text, however long, exhausts the matcher's stack. A text that has none of the marks that some
pattern needs (``NEEDS``) can't match and is not searched.

Defined results: a null text stays null with nothing found, an empty one empty. Repeated rows and further columns don't
matter, except that columns named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name
from .linededup import _let

ROUNDS = 6
_DAYS = 270  # 270 * 270 days make a block
_HEX = "0123456789abcdef"

EMAIL = r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w/-])"
PHONE = r"(?<![\w+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5})(?!\w)"
SECRET = r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3})(?:\"[^\"\s]{6,}\"|'[^'\s]{6,}'|[^\s\"',;]{6,})|\bAKIA[0-9A-Z]{16}\b"
#: What every match of a pattern has in it: a digit, an @, or a secret's label or mark.
NEEDS = r"[0-9@]|AKIA|(?i:password|passwd|pwd|token|secret|api[_-]?key)"
KINDS = (("secret", SECRET), ("email", EMAIL), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("ip", IPV4), ("date", DATE), ("phone", PHONE))


def _anywhere() -> str:
    """All patterns as one; only CARD has a group that is referred to."""
    return "|".join(f"(?:{p})" for _, p in KINDS)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs (0 <= left < a, 0 <= right < b), as a struct."""
    kinds = "struct<l:bigint,r:bigint>"

    def step(s: Column, r: Column) -> Column:
        by = _number(F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), F.when(r % 2 == 1, s["l"]).otherwise(s["r"]).cast("string")), 256))
        return F.when(r % 2 == 1, F.struct(s["l"].alias("l"), ((s["r"] + by) % b).alias("r"))).otherwise(F.struct(((s["l"] + by) % a).alias("l"), s["r"].alias("r"))).cast(kinds)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")).cast(kinds), step)


def _shifted(part: Column, digest: Column, hexed: bool) -> Column:
    """Each character moved within its class by a byte of ``digest`` (64 bytes, used in turn)."""

    def one(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, (1 + 2 * (i % 64)).cast("int"), F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        if hexed:
            place = F.when(code >= 97, code - 87).otherwise(code - 48)
            return F.substring(F.lit(_HEX), ((place + by) % 16 + 1).cast("int"), F.lit(1))
        turn = lambda base, n: F.char((F.lit(base) + (code - base + by) % n).cast("long"))
        return F.when(code.between(48, 57), turn(48, 10)).when(code.between(65, 90), turn(65, 26)).when(code.between(97, 122), turn(97, 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(part, ""), lambda c: c != ""), one), "")


def class_feistel(s: Column, key: str, kind: str, hexed: bool = False) -> Column:
    """A keyed permutation of strings that keeps each character's class (or of lower-case hex strings)."""

    kinds = "struct<l:string,r:string>"

    def step(x: Column, r: Column) -> Column:
        odd = r % 2 == 1
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), r.cast("string"), F.lit("|"), F.when(odd, x["l"]).otherwise(x["r"])), 512)
        part = _let(digest, lambda d: _shifted(F.when(odd, x["r"]).otherwise(x["l"]), d, hexed))  # one digest for all characters
        return F.struct(F.when(odd, x["l"]).otherwise(part).alias("l"), F.when(odd, part).otherwise(x["r"]).alias("r")).cast(kinds)

    half = F.floor(F.length(s) / 2).cast("int")
    first = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r")).cast(kinds)
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, step, lambda x: F.concat(x["l"], x["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1))
    return F.aggregate(F.transform(each, value), F.lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    """Remainder by 97 of an IBAN body, letters counting as 10 to 35."""
    each = F.filter(F.split(s, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda r, c: F.when(F.ascii(c) >= 65, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97))


def _dressed(digits: Column, like: Column) -> Column:
    """``digits`` with the separators that ``like`` has in its first 19 places of four (a card's form)."""
    return F.when(F.length(like) == F.length(digits), digits).otherwise(F.regexp_replace(digits, r"^(\d{4})(\d{4})(\d{4})(\d{4})$", "$1@$2@$3@$4"))


def _card(m: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        body = class_feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    def whole(d: Column) -> Column:
        separator = F.regexp_extract(m, r"[ -]", 0)
        return F.when(luhn_sum(d) % 10 == 0, F.replace(_dressed(valid(d), m), F.lit("@"), separator)).otherwise(m)

    return _let(_digits(m), whole)


def _iban(m: Column, key: str) -> Column:
    def whole(s: Column) -> Column:
        body = F.substring(s, F.lit(5), F.length(s))
        fine = (mod97(F.concat(body, F.substring(s, 1, 4))) == 1) & F.length(s).between(15, 34)
        made = _let(class_feistel(body, key, "iban"), lambda b: F.concat(F.substring(s, 1, 2), F.lpad((98 - mod97(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = F.when(F.instr(m, " ") > 0, F.trim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
        return F.when(fine, spaced).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), whole)


def _ip(m: Column, key: str) -> Column:
    def whole(o: Column) -> Column:
        fine = ~F.exists(o, lambda x: (x > 255) | x.isNull())
        made = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        part = lambda v: F.concat(F.floor(v / 256).cast("string"), F.lit("."), (v % 256).cast("string"))
        return F.when(fine, _let(made, lambda x: F.concat(part(x["l"]), F.lit("."), part(x["r"])))).otherwise(m)

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), whole)


def _ssn(m: Column, key: str) -> Column:
    def whole(p: Column) -> Column:
        area = p["a"]
        fine = (area > 0) & (area < 900) & (area != 666) & (p["g"] > 0) & (p["s"] > 0)
        made = feistel(F.when(area < 666, area - 1).otherwise(area - 2), (p["g"] - 1) * 9999 + p["s"] - 1, 898, 99 * 9999, key, "ssn")

        def shown(x: Column) -> Column:
            back = F.when(x["l"] < 665, x["l"] + 1).otherwise(x["l"] + 2)
            return F.format_string("%03d-%02d-%04d", back, F.floor(x["r"] / 9999) + 1, x["r"] % 9999 + 1)

        return F.when(fine, _let(made, shown)).otherwise(m)

    part = lambda at, n: F.substring(m, at, n).cast("int")
    return _let(F.struct(part(1, 3).alias("a"), part(5, 2).alias("g"), part(8, 4).alias("s")), whole)


def _date(m: Column, key: str) -> Column:
    iso = F.substring(m, 5, 1) == "-"
    separator = F.when(iso, F.lit("-")).otherwise(F.substring(m, 3, 1))
    day_first = F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2))
    month_first = F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 1, 2), F.lit("-"), F.substring(m, 4, 2))
    as_iso, as_day, as_month = (F.try_to_date(x, "yyyy-MM-dd") for x in (m, day_first, month_first))
    date = F.when(iso, as_iso).otherwise(F.coalesce(as_day, as_month))
    form = F.when(iso, F.lit("i")).when(as_day.isNotNull(), F.lit("d")).otherwise(F.lit("m"))

    def whole(x: Column) -> Column:
        n = F.datediff(x["d"], F.lit("1900-01-01").cast("date"))
        block = F.floor(n / (_DAYS * _DAYS))
        inside = n - block * (_DAYS * _DAYS)
        made = feistel(F.floor(inside / _DAYS), inside % _DAYS, _DAYS, _DAYS, key, "date")
        moved = _let(made, lambda y: F.date_add(F.lit("1900-01-01").cast("date"), (block * (_DAYS * _DAYS) + y["l"] * _DAYS + y["r"]).cast("int")))

        def shown(y: Column) -> Column:
            year, month, day = F.date_format(y, "yyyy"), F.date_format(y, "MM"), F.date_format(y, "dd")
            return F.when(x["f"] == "i", F.concat_ws("-", year, month, day)).when(x["f"] == "d", F.concat(day, x["s"], month, x["s"], year)).otherwise(F.concat(month, x["s"], day, x["s"], year))

        return F.when(x["d"].isNull(), m).otherwise(_let(moved, shown))

    return _let(F.struct(date.alias("d"), form.alias("f"), separator.alias("s")), whole)


def _phone(m: Column, key: str) -> Column:
    """Ten digits of the North American plan stay in the plan; other numbers keep their country code's first digit."""

    def whole(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        area, rest = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 7).cast("long")
        fine = ((F.length(d) == 10) | ((F.length(d) == 11) & F.startswith(d, F.lit("1")))) & (area >= 200) & (rest >= 2_000_000)
        plan = _let(feistel(area - 200, rest - 2_000_000, 800, 8_000_000, key, "phone"), lambda x: F.concat((x["l"] + 200).cast("string"), (x["r"] + 2_000_000).cast("string")))
        head = F.when(fine, F.substring(d, F.lit(1), F.length(d) - 10)).otherwise(F.substring(d, 1, 1))
        tail = F.when(fine, plan).otherwise(class_feistel(F.substring(d, F.lit(2), F.length(d)), key, "phone-other"))
        return _let(F.concat(head, tail), put)

    def put(new: Column) -> Column:
        chars = F.filter(F.split(m, ""), lambda c: c != "")
        is_digit = lambda c: F.ascii(c).between(48, 57)
        place = lambda i: F.size(F.filter(F.slice(chars, 1, i + 1), is_digit))
        return F.array_join(F.transform(chars, lambda c, i: F.when(is_digit(c), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")

    return _let(_digits(m), whole)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(class_feistel(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    label = F.regexp_extract(m, r"^(AKIA|(?i:[\w-]+\s{0,3}[=:]\s{0,3}[\"']?))", 1)

    def whole(v: Column) -> Column:
        return F.when(v.rlike("^[0-9a-f]+$"), class_feistel(v, key, "secret-hex", hexed=True)).otherwise(class_feistel(v, key, "secret"))

    return F.concat(label, _let(F.substring(m, F.length(label) + 1, F.length(m)), whole))


_MAKERS = {"secret": _secret, "email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "ip": _ip, "date": _date, "phone": _phone}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match of the patterns; the match itself where it isn't valid."""
    made = None
    for kind, pattern in KINDS:
        hit, value = match.rlike(f"^(?:{pattern})$"), _MAKERS[kind](match, key)
        made = F.when(hit, value) if made is None else made.when(hit, value)
    return made.otherwise(match)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", clean_col: str = "_clean", found_col: str = "_found") -> DataFrame:
    """``docs`` with ``clean_col``, the text with pseudonyms, and ``found_col``, the number of values replaced."""
    others = [c for c in docs.columns if c.lower() not in (clean_col.lower(), found_col.lower())]
    hits, new = fresh_name(docs, "hits"), fresh_name(docs, "new")
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike(NEEDS), F.regexp_extract_all(text, F.lit(_anywhere()), F.lit(0))).otherwise(F.array().cast("array<string>"))
    made = docs.withColumn(hits, found).withColumn(new, F.transform(hits, lambda m: pseudonym(m, key)))

    def joined(gaps: Column) -> Column:
        return F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(hits)), F.col(new), lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1))

    clean = F.when(F.size(hits) == 0, text).otherwise(_let(F.split(text, _anywhere(), -1), joined))
    changed = F.size(F.filter(F.arrays_zip(F.col(hits).alias("h"), F.col(new).alias("n")), lambda x: x["h"] != x["n"]))
    return made.select(*[F.col(f"`{c}`") for c in others], clean.alias(clean_col), F.when(text.isNull(), 0).otherwise(changed).cast("long").alias(found_col))


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_found, text`` (pseudonymised)."""
    made = pseudonymise(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key)
    return made.select("doc_id", F.col("_found").alias("n_found"), F.col("_clean").alias("text"))
