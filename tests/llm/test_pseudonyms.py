import datetime
import re

import pytest
from pyspark.sql import functions as F

from wardledger.llm.pseudonyms import KINDS, feistel, permuted_digits, pseudonym_report, pseudonymize

TEXT = (
    "card 4845168114407329, bad 4845168114407328; 4550-9978-1072-0808 mail und.34@mail7.example.com. ip 97.51.17.173 "
    "300.1.1.1 iban DE89370400440532013000 GB82 WEST 1234 5698 7654 32 born 1985-02-28 31/12/2001 12/31/2001 2001-13-01 "
    "ssn 123-45-6789 000-12-3456 call +1 (017) 555-5036 (415) 555-2671 +49 30 1234567 +14155552671###"
)


def luhn(s):
    d = [int(x) for x in re.sub(r"\D", "", s)[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def shape(s):
    return re.sub(r"\d", "9", s)


def test_values_keep_their_format_and_validity(docs):
    row = pseudonymize(docs((1, TEXT)), "k").first()
    new, counts = row["text"], row["pii_counts"]
    assert counts.asDict() == {"email": 1, "iban": 2, "card": 2, "ssn": 1, "date": 3, "ip": 1, "phone": 4}
    for kept in ("4845168114407328", "300.1.1.1", "2001-13-01", "000-12-3456"):
        assert kept in new
    for gone in ("4845168114407329", "4550-9978-1072-0808", "und.34@", "97.51.17.173", "DE89", "1985-02-28", "123-45-6789", "(017) 555-5036"):
        assert gone not in new
    mail = r"\S+@[\w.]+\w"
    octets = lambda t: re.sub(r"\d+(?:\.\d+){3}", "IP", re.sub(mail, "MAIL", t))
    assert shape(octets(new)) == shape(octets(TEXT))
    cards = [c for c in re.findall(r"4\d{3}-?\d{4}-?\d{4}-?\d{4}", new) if c != "4845168114407328"]
    assert len(cards) == 2 and all(map(luhn, cards))
    assert mod97(re.search(r"DE\d{20}", new)[0]) == 1 == mod97(re.search(r"GB\d\d WEST [\d ]{17}", new)[0])
    datetime.date.fromisoformat(re.search(r"born (19\d\d-\d\d-\d\d)", new)[1])
    assert all(int(x) < 256 for x in re.search(r"ip (\d+\.\d+\.\d+\.\d+)", new)[1].split("."))


def test_equal_values_stay_linked_and_keys_matter(docs):
    rows = [(1, "a 4845168114407329 b"), (2, "4845-1681-1440-7329"), (2, "4845-1681-1440-7329"), (3, "x@y.org X@Y.ORG")]
    found = [r["text"] for r in pseudonymize(docs(*rows), "k").orderBy("doc_id").collect()]
    digits = [re.sub(r"\D", "", t) for t in found[:3]]
    assert digits[0] == digits[1] == digits[2] != "4845168114407329"
    assert len(set(found[3].split())) == 1
    assert pseudonymize(docs(*rows), "other").orderBy("doc_id").first()["text"] != found[0]


def test_odd_rows_and_columns(docs):
    long = "word " * 200_000 + "+1 (017) 555-5036"
    rows = [(1, None), (2, ""), (3, long), (None, "é4845168114407329é"), (4, "4845168114407329"), (5, "a" * 300_000 + "@")]
    df = docs(*rows).withColumn("pii_counts", F.lit(1))
    out = pseudonymize(df, "k")
    assert sorted(out.columns) == sorted(df.columns)
    found = {r["doc_id"]: r for r in out.collect()}
    assert found[1]["text"] is None and found[2]["text"] == "" and found[None]["text"] == "é4845168114407329é"
    assert found[3]["text"].startswith("word word") and "555-5036" not in found[3]["text"]
    assert luhn(found[4]["text"]) and len(found[4]["text"]) == 16
    assert sum(found[1]["pii_counts"]) == 0
    report = pseudonym_report(docs(*rows), "k")
    assert report.columns == ["doc_id", "text", *[f"n_{k}" for k in KINDS]] and report.count() == len(rows)
    assert pseudonym_report(docs().limit(0), "k").count() == 0


def test_no_python_in_the_plan(docs):
    plan = pseudonym_report(docs((1, TEXT)), "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_digits_are_permuted(spark, n):
    df = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("d"))
    found = [r[0] for r in df.select(permuted_digits(F.col("d"), "k", "t")).collect()]
    assert len(set(found)) == 10**n and {len(x) for x in found} == {n}


def test_mixed_sizes_are_permuted(spark):
    df = spark.range(92 * 397).select(feistel(F.floor(F.col("id") / 397), F.col("id") % 397, F.lit(92), F.lit(397), "k", F.lit("t")).alias("x"))
    assert df.select("x.left", "x.right").filter("left < 92 and right < 397").distinct().count() == 92 * 397


def test_dates_are_permuted_within_their_century(spark):
    days = spark.range(36525).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    found = [r[0] for r in pseudonymize(days, "k").select("text").collect()]
    assert len(set(found)) == len(found) == 36525 and {x[:2] for x in found} == {"20"}


def test_equal_phone_numbers_stay_linked(docs):
    forms = ["+14155552671", "+1 415 555 2671", "+1 415-555-2671", "+442079460958", "+44 20 7946 0958", "+353 86 234 5678", "+353862345678"]
    found = pseudonymize(docs(*enumerate(forms)), "k").orderBy("doc_id").collect()
    digits = ["".join(c for c in r["text"] if c.isdigit()) for r in found]
    assert len(set(digits[:3])) == 1 and digits[3] == digits[4] and digits[5] == digits[6]
    assert [d[:n] for d, n in zip(digits, (1, 1, 1, 2, 2, 3, 3), strict=True)] == ["1", "1", "1", "44", "44", "353", "353"]
    assert all(d != "".join(c for c in f if c.isdigit()) for d, f in zip(digits, forms, strict=True))


def test_a_column_named_like_an_own_one_passes_through(docs):
    from pyspark.sql import functions as F

    df = docs((1, "10.0.0.1")).withColumns({"found": F.lit("kept"), "Found_": F.lit(7)})
    row = pseudonymize(df, "k").first()
    assert (row["found"], row["Found_"], row["pii_counts"]["ip"]) == ("kept", 7, 1)
