"""Personal data in texts, replaced by format-preserving keyed pseudonyms. Built-in functions only.

Numbers and dates that pass their validation are permuted within their own format by an alternating Feistel network
whose round function is a keyed SHA-256; so a value has the same pseudonym in every document, two values never share
one, and a card is still a valid card, a date a date of its century. An e-mail address, which is no number, becomes
a keyed address in the reserved domain ``invalid``.

| kind | found as | validated by | permuted |
| --- | --- | --- | --- |
| email | address | form | whole, by keyed hash |
| iban | two letters, 13 to 32 letters or digits, also in fours | remainder 1 modulo 97 | digits of the account; check digits follow |
| card | 13 to 19 digits, also in groups | Luhn sum | all but the first and the check digit |
| ssn | 3-2-4 digits | issued ranges | within the issued ranges |
| date | year-month-day, or two numbers and a year | the calendar | within the century |
| ip | four numbers with dots | each at most 255 | 32 bits |
| phone | +country code, or area code in brackets or with dashes | 8 to 15 digits | all but the country code |

What fails its validation stays. A null text stays null, an empty one empty. Rows are independent, so ties and
repeated rows get equal results, and an empty table an empty one. Texts are read whole. The other columns pass
through; an input column that has the name of the output column ``counts_column`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.llm.names import free_name

#: The country codes of one and of two digits; all others have three.
COUNTRY_CODE = "^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|81|82|84|86|9[0-58]|[0-9]{3})"
KINDS = ("email", "iban", "card", "ssn", "date", "ip", "phone")
ROUNDS = 8
DATE_FORMS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy")

# No quantifier can run over the same characters twice, so a search takes time linear in the text.
_EDGE, _END = r"(?<![\p{L}\p{Nd}])", r"(?![\p{L}\p{Nd}])"
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}",
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?){_END}",
    "card": rf"{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|3[0-9]{{3}}([ -])[0-9]{{6}}\2[0-9]{{5}}){_END}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "date": rf"{_EDGE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}){_END}",
    "ip": rf"(?<![\p{{L}}\p{{Nd}}.])[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}(?!\.?[\p{{L}}\p{{Nd}}])",
    "phone": rf"(?<![\p{{L}}\p{{Nd}}+])(?:\+[0-9]{{1,3}}[ .-]?\([0-9]{{1,4}}\)[ .-]?[0-9]{{2,4}}(?:[ .-][0-9]{{2,4}}){{0,3}}"
    rf"|\+[0-9]{{8,15}}|\+[0-9]{{1,3}}(?:[ .-][0-9]{{2,8}}){{2,4}}|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}"
    rf"|[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}){_END}",
}
#: Any form; only the card's groups refer back, by their place among all groups.
PATTERN = "|".join(FORMS.values())
_WHOLE = {kind: f"^(?:{form})$" for kind, form in FORMS.items()}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _sum(sequence: Column, of) -> Column:
    return F.aggregate(sequence, F.lit(0).cast("long"), lambda total, x: total + of(x))


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """A struct ``left``, ``right``: a keyed permutation of the pairs below the two sizes."""

    def draw(i, half, size):
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i, half), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def step(s, i):
        even = i % 2 == 0
        size, moved = F.when(even, left_size).otherwise(right_size), F.when(even, s["left"]).otherwise(s["right"])
        new = (moved + draw(i, F.when(even, s["right"]).otherwise(s["left"]), size)) % size
        return _let(
            new.cast("long"),
            lambda x: F.struct(F.when(even, x).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(x).alias("right")),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of as many digits; a single digit is shifted by a keyed amount."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("long")
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
    out = feistel(
        number(F.substring(digits, F.lit(1), half)),
        number(F.substring(digits, half + 1, n - half)),
        size(half),
        size(n - half),
        key,
        F.concat(F.lit(f"{kind}|"), n),
    )
    return _let(
        out, lambda x: F.concat(F.lpad(x["left"].cast("string"), half, "0"), F.lpad(x["right"].cast("string"), n - half, "0"))
    )


def filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""

    def fill(form, digits):
        def char(i):
            c = F.substring(form, i, F.lit(1))
            place = F.length(_digits(F.substring(form, F.lit(1), i)))
            return F.when(c.between("0", "9"), F.substring(digits, place, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), char), "")

    return _let(F.struct(form.alias("form"), digits.alias("digits")), lambda x: fill(x["form"], x["digits"]))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum where the last digit counts once."""

    def weighed(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return _sum(F.sequence(F.lit(0), F.length(digits) - 1), weighed)


def _card(m: Column, key: str) -> Column:
    def checked(head):
        check = (10 - _luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10
        return F.concat(head, check.cast("string"))

    def digits_of(digits):
        middle = permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card")
        return _let(F.concat(F.substring(digits, 1, 1), middle), checked)

    return filled(m, _let(_digits(m), digits_of))


def _mod97(account: Column, country: Column, check: Column) -> Column:
    moved = F.concat(account, country, check)

    def add(rest, i):
        c = F.substring(moved, i, F.lit(1))
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return ((rest * F.when(value > 9, 100).otherwise(10) + value) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add)


def _iban_parts(m: Column) -> tuple[Column, Column, Column]:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    return F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 2), F.substring(flat, 3, 2)


def _iban(m: Column, key: str) -> Column:
    account, country, _ = _iban_parts(m)

    def checked(new):
        check = F.lpad((98 - _mod97(new, country, F.lit("00"))).cast("string"), 2, "0")
        return F.concat(check, _digits(new))

    return filled(m, _let(filled(account, permuted_digits(_digits(account), key, "iban")), checked))


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _ssn_parts(m)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)  # 898 areas: 1 to 899 without 666
    out = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))

    def text(x):
        new = x["left"] + 1 + F.when(x["left"] + 1 >= 666, 1).otherwise(0)
        return F.format_string("%03d-%02d-%04d", new, F.floor(x["right"] / 9999) + 1, x["right"] % 9999 + 1)

    return _let(out, text)


def _date_format(m: Column) -> Column:
    """The format by which a date is valid; day before month where both are."""
    return F.coalesce(*[F.when(_day(m, f).isNotNull(), F.lit(f)) for f in DATE_FORMS])


def _day(m: Column, form: str) -> Column:
    year, month, day = (F.substring(m, form.index(c) + 1, form.count(c)) for c in "yMd")
    right_form = F.regexp_replace(m, "[0-9]", "0") == form.replace("y", "0").replace("M", "0").replace("d", "0")
    return F.when(right_form, F.concat_ws("-", year, month, day).try_cast("date"))


def _date(m: Column, key: str) -> Column:
    """Days are counted within the century, of 92 * 397 or, where its first year is a leap year, 75 * 487 days."""

    def moved_day(day):
        century = F.floor(F.year(day) / 100).cast("int")
        begin = F.make_date(century * 100, F.lit(1), F.lit(1))
        leap = century % 4 == 0
        a, b = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
        place = F.datediff(day, begin)
        moved = feistel(F.floor(place / b), place % b, a, b, key, F.concat(F.lit("date|"), century))
        return _let(moved, lambda x: F.date_add(begin, (x["left"] * b + x["right"]).cast("int")))

    out = F.lit(None).cast("string")
    for form in reversed(DATE_FORMS):
        day = _day(m, form)
        out = F.when(day.isNotNull(), F.date_format(_let(day, moved_day), form)).otherwise(out)
    return out


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("long"))


def _ip(m: Column, key: str) -> Column:
    o = _octets(m)
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))

    def text(x):
        parts = [F.floor(x["left"] / 256), x["left"] % 256, F.floor(x["right"] / 256), x["right"] % 256]
        return F.concat_ws(".", *[p.cast("string") for p in parts])

    return _let(out, text)


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY_CODE, 0))).otherwise(0)
    own = F.substring(digits, code + 1, F.length(digits))
    return filled(m, F.concat(F.substring(digits, F.lit(1), code), permuted_digits(own, key, "phone")))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def kind_of(m: Column) -> Column:
    """The kind of which ``m`` is a valid value, or null."""
    digits = _digits(m)
    account, country, check = _iban_parts(m)
    area, group, serial = _ssn_parts(m)
    valid = {
        "email": F.lit(True),
        "iban": _mod97(account, country, check) == 1,
        "card": (_luhn_sum(digits) % 10 == 0) & (_digits(m) != F.repeat(F.lit("0"), F.length(digits))),
        "ssn": (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0),
        "date": _date_format(m).isNotNull(),
        "ip": F.forall(_octets(m), lambda x: x <= 255),
        "phone": F.length(digits).between(8, 15),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(_WHOLE[kind]), F.when(valid[kind], F.lit(kind))).otherwise(out)
    return out


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    makers = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone}
    out = m
    for name in KINDS:
        out = F.when(kind == name, makers[name](m, key)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text_column: str = "text", counts_column: str = "pii_counts") -> DataFrame:
    """``docs`` with pseudonyms in its texts, and how many values of each kind were replaced."""
    text = F.col(text_column)
    holds = text.rlike("[0-9@]")
    matches = F.when(holds, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    names = [c for c in docs.columns if c != counts_column]
    own = free_name(docs, "found")
    found = docs.withColumn(own, F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    new = F.transform(F.col(own), lambda x: F.coalesce(pseudonym(x["kind"], x["m"], key), x["m"]))
    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    def count(kind):
        return F.size(F.filter(F.col(own), lambda x: x["kind"] == kind)).cast("long").alias(kind)

    counts = F.struct(*[count(kind) for kind in KINDS])
    replaced = F.when(F.size(F.col(own)) > 0, joined).otherwise(text)
    return found.select(*[replaced.alias(c) if c == text_column else F.col(c) for c in names], counts.alias(counts_column))


def pseudonym_report(docs: DataFrame, key: str) -> DataFrame:
    """The new text of every document and the number of replaced values by kind."""
    out = pseudonymize(docs, key)
    return out.select("doc_id", "text", *[F.col(f"pii_counts.{k}").alias(f"n_{k}") for k in KINDS])
