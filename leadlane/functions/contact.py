"""E-mail, website and lead-id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlane.functions.text import SPACE, let, strip, to_str

# Patterns.
_AT = rf"(?iu){SPACE}*[\[(]{SPACE}*at{SPACE}*[\])]{SPACE}*"
_EMAIL = r"^[^@]+@[^@]+\.[^@]+$"
_SCHEME = r"(?iu)^https?://"
_WWW = r"(?iu)^www\."
_TLD = r"\.([a-z]+)(?:/|$)"
_ID_DIGITS = r"(?U)(\d{2,})"
_DUP_SUFFIX = r"(?iu)-dup$"


def email_text(cell: Column) -> Column:
    """The address with spelled-out at signs and spaces removed, whether or not it is usable."""
    spelled_out = cell.contains("[") | cell.contains("(")
    address = F.when(spelled_out, F.regexp_replace(cell, _AT, "@")).otherwise(cell)
    return F.lower(F.replace(address, F.lit(" "), F.lit("")))


def email_or_null(address: Column) -> Column:
    return F.when(address.contains("@"), address)


def email_is_valid(address: Column) -> Column:
    """One at sign, a dot inside what follows it, and no whitespace."""
    return F.coalesce(address.contains("@") & address.rlike(_EMAIL) & ~address.rlike(SPACE), F.lit(False))


def clean_email(raw: Column) -> Column:
    """Struct of ``email`` (null when there is no at sign) and ``email_valid``."""
    return let(
        let(to_str(raw), email_text),
        lambda address: F.struct(
            email_or_null(address).alias("email"), email_is_valid(address).alias("email_valid")
        ),
    )


def email_domain(email: Column) -> Column:
    """Text after the last at sign of a cleaned address."""
    return F.when(email.contains("@"), F.nullif(F.substring_index(email, "@", -1), F.lit("")))


def website_text(cell: Column) -> Column:
    """Lower-case site without scheme, ``www.`` and final slashes; empty if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(cell, _SCHEME, ""), _WWW, "")
    return strip(F.lower(F.rtrim(bare, F.lit("/"))))


def empty_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def clean_website(raw: Column) -> Column:
    return let(let(to_str(raw), website_text), empty_to_null)


def website_tld(site: Column) -> Column:
    """Top-level domain of a cleaned website, a proxy for geography."""
    return F.nullif(F.regexp_extract(site, _TLD, 1), F.lit(""))


def id_digits(cell: Column) -> Column:
    """First run of two or more digits, empty if there is none."""
    return F.regexp_extract(cell, _ID_DIGITS, 1)


def is_explicit_dup(cell: Column) -> Column:
    return F.coalesce(cell.rlike(_DUP_SUFFIX), F.lit(False))


def parse_lead_id(raw: Column) -> Column:
    """Struct of ``raw``, ``canonical``, ``is_explicit_dup`` and ``looks_valid``."""
    return let(
        to_str(raw),
        lambda cell: let(
            let(id_digits(cell), empty_to_null),
            lambda canonical: F.struct(
                cell.alias("raw"),
                canonical.alias("canonical"),
                is_explicit_dup(cell).alias("is_explicit_dup"),
                canonical.isNotNull().alias("looks_valid"),
            ),
        ),
    )
