"""Amounts of money in Korean notation, and the bands of approval matrices.

Two readings exist and differ on purpose: in questions `1억5천` means 150,000,000 (an elided 만), in matrices it is
read digit by digit as 100,005,000.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructType

# Units.
SMALL = {"십": 10, "백": 100, "천": 1000}
BIG = {"만": 10_000, "억": 100_000_000}
_UNITS = "억만천백십"
_AMOUNT = re.compile(rf"[0-9{_UNITS}](?:[\s,]*[0-9{_UNITS}])*\s*원?")
_BAND = re.compile(rf"(?P<amount>[0-9,{_UNITS}]*[0-9][0-9,{_UNITS}]*)\s*원?\s*(?P<bound>이하|이상|초과|미만)?")


def _groups(text: str) -> list[tuple[int | None, int, str]]:
    """Splits digits and units into groups of below 만: (plain digits at the end or None, value of small units, big unit or '')."""
    out = []
    for body, unit in re.findall(r"([0-9천백십]*)([만억]?)", text):
        if not body and not unit:
            continue
        small = sum(int(n or 1) * SMALL[u] for n, u in re.findall(r"(\d*)([천백십])", body))
        tail = re.search(r"(\d+)$", body)
        out.append((int(tail[1]) if tail else None, small, unit))
    return out


def question_amount(text: str | None, strict: bool = True) -> int | None:
    """First amount with a unit or 원 in a question; null for bare digits and for zero.

    strict asks for a digit, 원, 만 or 억 in it, so that a 백 inside a word is no amount.
    """
    text = " ".join(unicodedata.normalize("NFKC", text or "").split())
    for m in _AMOUNT.finditer(text):
        found = m[0].strip()
        units = re.search(f"[{_UNITS}]", found)
        if not units and not found.endswith("원"):
            continue
        if strict and not re.search("[0-9원만억]", found):
            continue
        groups = _groups(re.sub(r"[\s,원]", "", found))
        total = sum(((n or 0) + small) * BIG[unit] for n, small, unit in groups if unit)
        n, small, unit = groups[-1] if groups else (0, 0, "")
        if groups and not unit:
            hundred_million = any(u == "억" for _, _, u in groups)
            total += small * 10_000 if hundred_million and small and n is None else small + (n or 0)
        if total:
            return total
    return None


def matrix_amount(text: str) -> int:
    """Amount of a matrix cell: every group by its own unit, a bare 만 or 억 counting once."""
    total = 0
    for n, small, unit in _groups(text.replace(",", "")):
        value = (n or 0) + small
        total += (value or 1) * BIG[unit] if unit else value
    return total


def band(text: str | None) -> tuple[int | None, int | None, str | None]:
    """(least, most, error) of a band expression; null stands for no bound."""
    found = [(matrix_amount(m["amount"]), m["bound"]) for m in _BAND.finditer(text or "")]
    if not found:
        return None, None, None
    low = high = None
    if all(bound is None for _, bound in found):
        low, high = found[0][0], found[-1][0]
    else:
        for value, bound in found:
            if bound in ("이상", "초과"):
                low = value + (bound == "초과")
            elif bound:
                high = value - (bound == "미만")
    if low is not None and high is not None and low > high:
        return None, None, f"least {low} above most {high}"
    return low, high, None


@arrow_udf(LongType())
def question_amount_udf(values: pa.Array) -> pa.Array:
    return pa.array([question_amount(v) for v in values.to_pylist()], pa.int64())


@arrow_udf(StructType().add("amount_min", "long").add("amount_max", "long").add("error", "string"))
def band_udf(values: pa.Array) -> pa.Array:
    rows = [band(v) for v in values.to_pylist()]
    cols = [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
    return pa.StructArray.from_arrays(cols, ["amount_min", "amount_max", "error"])
