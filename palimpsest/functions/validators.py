"""Check digits and number rules as Column expressions; null and malformed values are not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of a bank routing number's digits.
ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
#: Middle groups that taxpayer numbers beginning with 9 may have.
ITIN_GROUPS = ((50, 65), (70, 88), (90, 92), (94, 99))
#: A legacy wallet address with a larger share of vowels than this is a word.
WALLET_VOWEL_SHARE = 0.3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_valid(value: Column) -> Column:
    """13 to 19 digits with a right check digit."""
    d = digits(value)
    return F.coalesce(F.length(d).between(13, 19) & F.call_function("luhn_check", d), F.lit(False))


def valid_ssn(value: Column) -> Column:
    """Nine digits of a number that can be issued; those from 900 on only in the taxpayer groups."""
    d = digits(value)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    itin = F.lit(False)
    for lo, hi in ITIN_GROUPS:
        itin = itin | group.cast("int").between(lo, hi)
    fine = (F.length(d) == 9) & ~area.isin("000", "666") & (group != "00") & (serial != "0000") & (~area.startswith("9") | itin)
    return F.coalesce(fine, F.lit(False))


def valid_routing(value: Column) -> Column:
    """Nine digits whose weighted sum ends in 0."""
    d = digits(value)
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(ABA_WEIGHTS)), F.lit(0))
    return F.coalesce((F.length(d) == 9) & (total % 10 == 0), F.lit(False))


def valid_iban(value: Column) -> Column:
    """Country, two check digits, up to 30 more; 1 modulo 97 once the first four stand last and
    letters count from 10."""
    v = F.upper(F.regexp_replace(value, " ", ""))
    turned = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))

    def step(rest, c):
        n = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(n < 10, rest * 10 + n).otherwise(rest * 100 + n) % 97

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))
    return F.coalesce(v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def valid_vin(value: Column) -> Column:
    """17 characters without I, O and Q, a digit and a letter among them."""
    v = F.upper(value)
    return F.coalesce(v.rlike(r"^[A-HJ-NPR-Z0-9]{17}$") & v.rlike("[0-9]") & v.rlike("[A-Z]"), F.lit(False))


def not_words(value: Column) -> Column:
    """A wallet address that doesn't read like words: without four small letters in a row, or with few
    vowels among its letters; bech32 ones never do."""
    letters = F.regexp_replace(value, r"[^\p{L}]", "")
    vowels = F.length(F.regexp_replace(F.lower(letters), "[^aeiou]", ""))
    return F.coalesce(value.startswith("bc1") | ~value.rlike("[a-z]{4}") | (vowels / F.length(letters) < WALLET_VOWEL_SHARE), F.lit(False))
