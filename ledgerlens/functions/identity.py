"""Card, national-code and mobile-number expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: Extended Arabic-Indic (Persian) and Arabic-Indic digits 0-9,
# mapped to ASCII 0-9. Python's ``\D`` treats both as digits, so they are kept.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"


def digits_only(c: Column) -> Column:
    """keep digits (Persian/Arabic digits folded to ASCII), drop the rest."""
    folded = F.translate(c, PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS + ASCII_DIGITS)
    return F.regexp_replace(folded, r"[^0-9]", "")


def mask_card(pan: Column) -> Column:
    """first 6 + 'x' * (len - 10) + last 4."""
    n = F.length(pan)
    return F.concat(F.substring(pan, 1, 6),
                    F.repeat(F.lit("x"), F.greatest(n - 10, F.lit(0))),
                    F.substring(pan, -4, 4))


def card_error(d: Column) -> Column:
    """P1a on stripped digits ``d``: NULL when 16 digits, else the error text."""
    return F.when(F.length(d) != 16,
                  F.concat(F.lit("card_pan باید ۱۶ رقم باشه، دریافت شد: "), F.length(d).cast("string")))


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).cast("int")


def national_code_valid(d: Column) -> Column:
    """P1b checksum on a 10-digit ASCII string: not all equal, and
    s = sum(d_i * (10 - i), i=0..8) mod 11; valid if (s<2 and d9=s) or (s>=2 and d9=11-s)."""
    s = sum((_digit(d, i) * (10 - i) for i in range(9)), F.lit(0)) % 11
    check = _digit(d, 9)
    all_equal = d.rlike(r"^(\d)\1{9}$")
    return (~all_equal) & (((s < 2) & (check == s)) | ((s >= 2) & (check == 11 - s)))


def national_code_error(d: Column, valid: Column | None = None) -> Column:
    """P1b on stripped digits ``d``: NULL when valid, else the error text.
    ``valid`` may carry a precomputed ``national_code_valid(d)``."""
    ok = national_code_valid(d) if valid is None else valid
    return (F.when(F.length(d) != 10, F.lit("کد ملی باید ۱۰ رقم باشه"))
             .when(~ok, F.concat(F.lit("کد ملی "), d, F.lit(" معتبر نیست (checksum)"))))


def _mobile_folded(d: Column) -> Column:
    """Fold +98 / 0098 / bare 9xx forms to the trunk-0 form (``d`` = digits)."""
    return (F.when(d.startswith("0098") & (F.length(d) == 14), F.concat(F.lit("0"), F.substring(d, 5, 10)))
             .when(d.startswith("98") & (F.length(d) == 12), F.concat(F.lit("0"), F.substring(d, 3, 10)))
             .when(d.startswith("9") & (F.length(d) == 10), F.concat(F.lit("0"), d))
             .otherwise(d))


def _mobile_nsn_valid(folded: Column) -> Column:
    # Iranian numbering plan: national significant number of 10 digits that does
    # not start with 0 (mobiles 9xx, fixed lines by area code), optional trunk 0.
    return folded.rlike(r"^0?[1-9][0-9]{9}$")


def mobile_folded(raw: Column) -> Column:
    """F2 first step: digits of the number folded to the national trunk form."""
    return _mobile_folded(digits_only(raw))


def normalize_mobile_e164(raw: Column, folded: Column | None = None) -> Column:
    """E.164 form (+98...). ``folded`` may carry ``mobile_folded(raw)``."""
    f = mobile_folded(raw) if folded is None else folded
    return F.concat(F.lit("+98"), F.regexp_replace(f, r"^0+", ""))


def normalize_mobile_national(raw: Column, folded: Column | None = None) -> Column:
    """national form (0...) for valid numbers, the folded digits otherwise."""
    f = mobile_folded(raw) if folded is None else folded
    return F.when(_mobile_nsn_valid(f), F.concat(F.lit("0"), F.regexp_replace(f, r"^0", ""))).otherwise(f)
