"""Field rules as boolean columns over raw text, and the validators made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Validator
from . import casts

# IBAN lengths by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KM": 27, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "OM": 23,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "YE": 30,
}
# Patterns and bounds of the message schemas.
BIC = r"^[A-Z0-9]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\z"
CURRENCY = r"^[A-Z]{3}\z"
COUNT = r"^[0-9]{1,15}\z"
HEADER_AMOUNT = (Decimal("0.01"), Decimal("999999999999999.99"))
TXN_AMOUNT = (Decimal("0.01"), Decimal("999999999.99"))

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mod97(v: Column) -> Column:
    """ISO 7064 remainder of digits and letters (A = 10)."""
    chars = F.filter(F.split(F.upper(v), ""), lambda c: c != "")
    value = lambda c: F.position(c, F.lit(_DIGITS)) - 1
    return F.aggregate(chars, F.lit(0), lambda r, c: (r * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _mod97_of_digits(v: Column) -> Column:
    """The remainder of an account of up to 34 characters, two letters and then digits: two pieces and the country, no fold."""
    letter = lambda k: (F.ascii(F.substring(v, k, 1)) - 55).cast("bigint")
    n = F.length(v)
    shift = F.pow(F.lit(10), F.greatest(n - 19, F.lit(0))).cast("bigint")
    # most have one piece
    bban = F.when(n <= 19, _number(v, 5, 15) % 97).otherwise((_number(v, 5, 15) % 97 * shift + _number(v, 20, 15)) % 97)
    return (bban * (10**6 % 97) + letter(1) * 10_000 + letter(2) * 100 + _number(v, 3, 2)) % 97


def _number(v: Column, at: int, n: int) -> Column:
    """Digits of a text of digits; 0 where it has none."""
    # a digit before, since a text of no digits would be an exception of the cast, caught for every row
    return F.coalesce(F.concat(F.lit("0"), F.substring(v, at, n)).try_cast("bigint"), F.lit(0).cast("bigint"))


def si_check(bban: Column) -> Column:
    """Slovenian account: 13 digits and the two check digits that belong to them."""
    base, check = F.substring(bban, 1, 13).try_cast("bigint"), F.substring(bban, 14, 2).try_cast("int")
    # base * 100 would leave the range of 64 bits only beyond 16 digits
    return F.coalesce(bban.rlike(r"^[0-9]{15}\z") & (98 - (base * 100) % 97 == check), F.lit(False))


def iban(v: Column) -> Column:
    """Country known, length right, characters right, remainder 1, and the national check where there is one."""
    country = F.substring(v, 1, 2)
    known = F.concat(country, F.length(v).cast("string")).isin([f"{c}{n}" for c, n in IBAN_LENGTHS.items()])
    bban = F.substr(v, F.lit(5), F.greatest(F.length(v) - 4, F.lit(0)))
    shape = v.rlike(r"^[A-Z]{2}[0-9]{2}[0-9A-Za-z]+\z")
    # of digits alone, which most are, no more is looked at; the fold runs only over texts of the right shape that have letters
    digits = v.rlike(r"^[A-Z]{2}[0-9]{2,32}\z")
    account = _number(v, 5, 15)
    si_of_digits = (country != "SI") | (98 - (account - account % 100) % 97 == account % 100)
    sound = F.when(~known, False).when(digits, (_mod97_of_digits(v) == 1) & si_of_digits)
    sound = sound.when(shape, (mod97(F.concat(bban, F.substring(v, 1, 4))) == 1) & ((country != "SI") | si_check(bban)))
    return F.coalesce(sound, F.lit(False))


def iban_print(v: Column) -> Column:
    """Upper case without white space, in blocks of four."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.upper(v), r"\s", ""), "(.{4})", "$1 "))


def iban_field() -> Validator:
    return Validator(iban, "invalid_iban", "invalid IBAN")


def member(values: str | Iterable[str], delimiter: str = ";") -> Validator:
    """Membership in a small set; ``values`` may be one packed text. Large sets: ``members``."""
    known = sorted({x for x in (values.split(delimiter) if isinstance(values, str) else values) if x})
    return Validator(lambda v: v.isin(known), "value_not_in_set", "value is not in the set")


def members(df: DataFrame, column: str, table: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """Rows whose value is (or is not) in a reference table of any size: a semi or anti join whose
    strategy the planner picks by size."""
    return df.join(table.select(F.col(key).alias(column)).distinct(), column, "left_anti" if negate else "left_semi")


def amount_between(low: int | Decimal, high: int | Decimal) -> Validator:
    bound = lambda x: F.lit(str(x)).cast("decimal(18,5)")
    return Validator(lambda v: casts.amount(v).between(bound(low), bound(high)), "amount_out_of_range", f"amount is not within {low} and {high}")


def matches(pattern: str, domain_code: str) -> Validator:
    return Validator(lambda v: v.rlike(pattern), domain_code, "value does not have the required form")


def custom(valid: Callable[[Column], Column], domain_code: str, message: str = "invalid value") -> Validator:
    """Any rule; ``valid`` may wrap a pandas UDF where no column expression will do."""
    return Validator(valid, domain_code, message)
