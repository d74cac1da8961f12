"""Checks on candidate values, as columns: each takes the value as found and gives a boolean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}$"
_NUMERIC_SHAPE = r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def max_digit_run(x: Column) -> Column:
    return F.array_max(F.transform(F.split(x, "[^0-9]"), F.length))


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", x)


def _weighted(x: Column, weights: tuple[int, ...], fold: bool) -> Column:
    """The sum of the digits' products with weights; a product of two digits counts as their sum if ``fold``."""
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        p = F.substring(x, i, 1).cast("int") * w
        total = total + (F.when(p > 9, p - 9).otherwise(p) if fold else p)
    return total


def israeli_id(x: Column) -> Column:
    d = digits(x)
    return (F.length(d) == 9) & (_weighted(d, (1, 2) * 4 + (1,), True) % 10 == 0)


def aba(x: Column) -> Column:
    d = digits(x)
    return (F.length(d) == 9) & (_weighted(d, (3, 7, 1) * 3, False) % 10 == 0)


def iban(x: Column) -> Column:
    """ISO 13616: the first four characters go last, letters count from 10, and the remainder by 97 is 1."""
    compact = F.upper(F.regexp_replace(x, r"\s", ""))
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    # a letter takes two decimal places
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
    return F.length(compact).between(15, 34) & compact.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1)


def card(x: Column) -> Column:
    d = F.regexp_replace(x, "[ -]", "")
    return F.length(d).between(13, 19) & luhn(d)


def phone(x: Column) -> Column:
    return ~x.rlike(_ISO_SHAPE) & ~x.rlike(_NUMERIC_SHAPE) & (max_digit_run(x) >= 2) & F.length(digits(x)).between(7, 15)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "iban": iban,
    "card": card,
    "phone": phone,
    "national_id": israeli_id,
    "aba": aba,
    "pem": lambda x: x.rlike(r"-----END [A-Z ]*PRIVATE KEY-----\z"),
    "not_unspecified": lambda x: x != "::",
    "grouped_number": lambda x: max_digit_run(x) >= 2,
}
