"""Text columns: canonical JSON, deterministic ids, identifiers, quantities and decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- canonical JSON and ids -------------------------------------------------------------

def canonical_json(**fields: Column) -> Column:
    """JSON object text with keys in alphabetical order and NULLs kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def stable_id(prefix: str, *parts: Column, digits: int = 32) -> Column:
    """``prefix_`` + leading hex digits of the SHA-256 over the ``|``-joined parts (NULL as empty)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text, 256), 1, digits))


def json_id(prefix: str, digits: int = 64, **fields: Column) -> Column:
    """``prefix_`` + SHA-256 over :func:`canonical_json`."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(canonical_json(**fields), 256), 1, digits))


# --- identifiers ------------------------------------------------------------------------

def symbol(c: Column | str) -> Column:
    """Trimmed upper case; blank gives NULL."""
    return F.nullif(F.upper(F.trim(_c(c))), F.lit(""))


def sector(c: Column | str, default: str = "UNKNOWN") -> Column:
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit(default))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_c(c)), F.lit(""))


def accession(c: Column | str) -> Column:
    """Eighteen digits or the dashed form to ``10-2-6``; anything else gives NULL."""
    raw = F.trim(_c(c))
    digits = F.regexp_replace(raw, "-", "")
    dashed = F.regexp_replace(digits, r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")
    return F.when(raw.rlike(r"^(\d{18}|\d{10}-\d{2}-\d{6})$"), dashed)


def document_path(c: Column | str, *, allow_folders: bool = True) -> Column:
    """Relative document name with forward slashes; a scheme, ``..`` or an empty name gives NULL."""
    path = F.regexp_replace(F.trim(F.regexp_replace(_c(c), r"\\", "/")), "^/+", "")
    bad = (path == "") | path.rlike(r"(^|/)\.\.(/|$)") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    if not allow_folders:
        bad = bad | path.contains("/")
    return F.when(~bad, path)


def filing_url(base: str, cik: Column | str, accession_no: Column | str, document: Column | str) -> Column:
    return F.concat_ws("/", F.lit(base.rstrip("/")), _c(cik).cast("long").cast("string"),
                       F.regexp_replace(_c(accession_no), "-", ""), document_path(document))


def client_order_id(c: Column | str, max_length: int = 128) -> Column:
    """ASCII id: unsafe runs become ``_``; over-long ids keep a prefix plus 12 hash digits."""
    ascii_only = F.regexp_replace(F.trim(_c(c)), r"[^\x00-\x7F]", "")
    safe = F.regexp_replace(F.regexp_replace(ascii_only, r"[^A-Za-z0-9_-]", "_"), "_+", "_")
    safe = F.nullif(F.regexp_replace(safe, r"^[_-]+|[_-]+$", ""), F.lit(""))
    short = F.concat(F.substring(safe, 1, max_length - 13), F.lit("-"), F.substring(F.sha2(safe, 256), 1, 12))
    return F.when(F.length(safe) <= max_length, safe).otherwise(short)


def clean_text(c: Column | str) -> Column:
    """NUL characters dropped, other control characters replaced by spaces."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"\x00", ""), r"[\x01-\x1F]", " ")


# --- numbers as text --------------------------------------------------------------------

def finite(c: Column | str) -> Column:
    """DOUBLE with NaN and infinities as NULL."""
    x = _c(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def decimal_value(c: Column | str) -> Column:
    """Decimal from text; blank, ``.`` and non-numbers give NULL."""
    text = F.trim(_c(c).cast("string"))
    return F.when((text != "") & (text != "."), text.try_cast("decimal(38,18)"))


def _plain(c: Column) -> Column:
    """Decimal as digits with all 18 places, never with an exponent."""
    return F.regexp_replace(F.format_number(c.cast("decimal(38,18)"), 18), ",", "")


def _trimmed(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.isin("-0", "0"), F.lit("0")).otherwise(text)


def decimal_text(c: Column | str) -> Column:
    """Plain notation without trailing zeros; zero is ``0``."""
    return _trimmed(_plain(_c(c)))


def quantity_text(c: Column | str) -> Column:
    """Order quantity: at most nine places, rounded down, no trailing zeros; not positive gives NULL."""
    x = finite(c)
    exact = F.when(x > 0, x.cast("string").try_cast("decimal(38,18)"))
    text = _trimmed(F.regexp_extract(_plain(exact), r"^(\d+\.\d{9})", 1))
    return F.when(text != "0", text)
