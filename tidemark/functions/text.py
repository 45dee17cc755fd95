"""Number formats of result tables, and the folding that keyword patterns expect."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of names that mean money.
MONEY = ("revenue", "sales", "amount", "price", "cost", "value")


def _accents() -> tuple[str, str]:
    """Characters with marks and the single characters that canonical decomposition leaves of them without its marks."""
    plain = {chr(i): "".join(c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c)[0] != "M") for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000}
    changed = [c for c, base in plain.items() if len(base) == 1 and base != c]
    return "".join(changed), "".join(plain[c] for c in changed)


ACCENTS = _accents()


def money_like(name: Column) -> Column:
    return F.lower(name).rlike("|".join(MONEY))


def is_money(name: str) -> bool:
    return any(w in name.lower() for w in MONEY)


def kpi_text(value: Column, kind: Column) -> Column:
    """$1,234 for currency, 1,234 for int, 1,234.50 for number, plain text else."""
    return (
        F.when(kind == "currency", F.concat(F.lit("$"), F.format_number(F.bround(value, 0), 0)))
        .when(kind == "int", F.format_number(value, 0)).when(kind == "number", F.format_number(value, 2)).otherwise(value.cast("string"))
    )


def number_text(value: Column, money: Column | bool = False) -> Column:
    """Whole numbers without decimals, others with two; an escaped dollar before money; n/a for a missing one."""
    money = F.lit(money) if isinstance(money, bool) else money
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    shown = F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return F.when(value.isNull() | F.isnan(value.cast("double")), "n/a").otherwise(F.concat(F.when(money, "\\$").otherwise(""), shown))


def folded(text: Column) -> Column:
    """Lower case without accents, be they part of a letter or marks after it, as the keyword patterns are written."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(low, *ACCENTS), r"\p{M}+", "")).otherwise(low)
