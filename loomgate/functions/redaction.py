"""Masks for personal data in results, hashes, and inline images. All column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns in their order of application, and the marks that take their place.
_WORD = r"\p{L}\p{N}_"  # what a word character is
EMAIL = rf"[{_WORD}.+-]+@[{_WORD}-]+\.[{_WORD}.-]+"
NUMBERS = {"RRN": r"\p{Nd}{6}-\p{Nd}{7}", "CARD": r"\p{Nd}{4}[- ]?\p{Nd}{4}[- ]?\p{Nd}{4}[- ]?\p{Nd}{4}", "PHONE": r"0\p{Nd}{1,2}-?\p{Nd}{3,4}-?\p{Nd}{4}"}
ACCOUNT = r"(?<![\p{Nd}-])(?=(?:\p{Nd}-?){9})\p{Nd}{2,6}(?:-\p{Nd}{2,6}){2,}(?![\p{Nd}-])"
MARKS = {"EMAIL": "[이메일]", "RRN": "[주민번호]", "CARD": "[카드]", "PHONE": "[전화]", "ACCOUNT": "[계좌번호]"}


def redact(c: Column, policy: str = "strict", account: bool = True) -> Column:
    """c with mail addresses, registration numbers, cards, phones and accounts masked, in that order.

    strict also masks numbers that a particle follows directly, ending them at digits; legacy ends them at words.
    """
    edge = r"\p{Nd}" if policy == "strict" else f"[{_WORD}]"
    out = F.regexp_replace(c, EMAIL, MARKS["EMAIL"])
    for name, pattern in NUMBERS.items():
        out = F.regexp_replace(out, f"(?<!{edge}){pattern}(?!{edge})", MARKS[name])
    return redact_accounts(out) if account else out


def redact_accounts(c: Column) -> Column:
    """c with accounts masked and nothing else."""
    return F.regexp_replace(c, ACCOUNT, MARKS["ACCOUNT"])


def email_hash(c: Column) -> Column:
    """SHA-256 of the stripped address in lower case; blank is null."""
    clean = F.lower(F.trim(c))
    return F.when(clean != "", F.sha2(clean.cast("binary"), 256))


def content_hash(body: Column, attachment_hashes: Column) -> Column:
    """SHA-256 of the body followed by |hash for each attachment hash in order; missing ones count as empty."""
    parts = F.transform(F.array_sort(F.transform(attachment_hashes, lambda x: F.coalesce(x, F.lit("")))), lambda x: F.concat(F.lit("|"), x))
    return F.sha2(F.concat(F.coalesce(body, F.lit("")), F.array_join(parts, "")).cast("binary"), 256)


def inline_image(content: Column, most: int = 5 * 1024 * 1024) -> Column:
    """Base64 of an image up to a size, else null."""
    return F.when(F.length(content) <= most, F.base64(content))
