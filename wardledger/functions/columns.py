"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"

# Patterns of the dosage fields inside an item description.
DOSAGE_KEYS = {
    "dosage": "frequency",
    "period": "period",
    "dosage_form": "dosage_form",
    "interval": "interval",
    "interval_uom": "interval_uom",
    "comment": "Doctor's comment",
}


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Column | str) -> Column:
    """Exact form of an amount: its sums do not depend on the order of the rows."""
    return col(value).cast(MONEY)


def money_sum(value: Column | str) -> Column:
    return F.sum(money(value)).cast("double")


def non_blank(value: Column | str) -> Column:
    """NULL for NULL and for the empty string."""
    return F.nullif(col(value), F.lit(""))


def is_blank(value: Column | str) -> Column:
    """NULL or empty, in a form that the parquet scan understands."""
    return col(value).isNull() | (col(value) == "")


def is_set(value: Column | str) -> Column:
    """A check field that is on; NULL counts as off. Both forms reach the parquet scan."""
    return col(value).isNotNull() & (col(value) != 0)


def is_unset(value: Column | str) -> Column:
    return col(value).isNull() | (col(value) == 0)


def differs(value: Column | str, other) -> Column:
    """Not equal, with NULL differing from every value."""
    return ~col(value).eqNullSafe(other)


def month_start(value: Column | str) -> Column:
    return F.trunc(col(value), "month")


def month_name(value: Column | str) -> Column:
    """Full English month name (Spark's own ``monthname`` abbreviates)."""
    return F.date_format(col(value), "MMMM")


def clock(value: Column | str) -> Column:
    return F.date_format(col(value), "HH:mm:ss")


def stable_id(*parts: Column | str) -> Column:
    """An id that a retried task computes again, unlike a random one."""
    return F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256)


def joined(pairs: Column, field: str, separator: str = ",") -> Column:
    """The ``field`` of an array of structs, in struct order, as text."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s[field]), separator)


def disease_code(code: Column | str) -> Column:
    """ICD code in the insurer's spelling: ``E119`` to ``E11.9``; overlong dotted codes lose the tail."""
    code = col(code)
    dotted = code.contains(".")
    return (
        F.when(~dotted & (F.length(code) > 3), F.concat_ws(".", code.substr(1, 3), code.substr(4, 1)))
        .when(dotted & (F.length(code) <= 5), code)
        .otherwise(code.substr(1, 3))
    )


def dosage_field(text: Column | str, key: str) -> Column:
    """Text after the first ``key:``. Blank lines may follow the key; the value is one line."""
    return non_blank(F.regexp_extract(col(text), rf"(?dU){key}:\s*(.+)", 1))


def violation(claim: Column | str, rule: str, detail: Column) -> list[Column]:
    return [col(claim).alias("claim"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")]
