"""Scalar functions on written values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import digits

#: Legal forms that an organisation's key leaves out.
ORG_SUFFIXES = ("inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "pllc", "pc", "na", "gmbh", "ag", "sa")


def match_case(new: Column, like: Column) -> Column:
    """``new`` in capitals or small letters if ``like`` is all of that."""
    letters = F.regexp_replace(like, r"[^\p{L}]", "")
    return F.when((letters != "") & (letters == F.upper(letters)) & (F.length(letters) > 1), F.upper(new)).when((letters != "") & (letters == F.lower(letters)), F.lower(new)).otherwise(new)


def pluralize(word: Column) -> Column:
    return F.concat(word, F.when(F.lower(word).rlike("(s|x|z|ch|sh)$"), "es").otherwise("s"))


def ocr_fold(value: Column) -> Column:
    """What a reader of print confuses becomes one: rn and m, vv and w, 0 and o, 1 i | ! and l, 5 $ and s."""
    return F.translate(F.replace(F.replace(F.lower(value), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w")), "01i|!5$", "olllls" + "s")


def one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, replacement or swap of neighbours apart."""
    near = F.levenshtein(a, b, 1) >= 0
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    i = F.get(spots, 0)
    swap = (F.length(a) == F.length(b)) & (F.size(spots) == 2) & (F.get(spots, 1) == i + 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return near | F.coalesce(swap, F.lit(False))


def alike(a: Column, b: Column) -> Column:
    """Equal; equal once folded, from 3 letters; or one edit apart, from 7 letters and with one initial."""
    x, y = F.lower(a), F.lower(b)
    longer = (F.least(F.length(x), F.length(y)) >= 7) & (F.substring(x, 1, 1) == F.substring(y, 1, 1))
    return (x == y) | ((F.least(F.length(x), F.length(y)) >= 3) & (ocr_fold(x) == ocr_fold(y))) | (longer & one_edit(x, y))


def typo(a: Column, b: Column) -> Column:
    """Words of letters, at least 4, that are one edit or swap apart."""
    fine = a.rlike(r"^\p{L}{4,}$") & b.rlike(r"^\p{L}{4,}$")
    return fine & (F.lower(a) != F.lower(b)) & one_edit(F.lower(a), F.lower(b))


def similar(a: Column, b: Column) -> Column:
    """Within one edit from 4 characters, within two from 9."""
    x, y = ocr_fold(a), ocr_fold(b)
    n = F.least(F.length(x), F.length(y))
    return (x == y) | ((n >= 9) & (F.levenshtein(x, y, 2) >= 0)) | ((n >= 4) & (F.levenshtein(x, y, 1) >= 0))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex digest, from two nested hashes with the padded key."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def pick(salt: bytes, n: int, *parts: Column) -> Column:
    """A number below ``n`` decided by the salt and the parts: the first 8 bytes of the keyed hash."""
    head = F.substring(hmac_sha256(salt, F.concat_ws("\x1f", *parts)), 1, 16)
    # the hash as two halves of 32 bits, as a long holds only 63 bits of it
    hi, lo = (F.conv(F.substring(head, a, 8), 16, 10).cast("long") for a in (1, 9))
    return ((hi % n) * F.lit((1 << 32) % n) + lo % n) % n


def placeholder(tag: Column, n: Column) -> Column:
    return F.concat(F.lit("["), tag, F.lit("-"), n.cast("string"), F.lit("]"))


def squeeze(value: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def fold(value: Column) -> Column:
    """Case-folded and squeezed: the form under which values are one."""
    return F.replace(F.lower(squeeze(value)), F.lit("ß"), F.lit("ss"))


def phone_key(value: Column) -> Column:
    """Ten digits, without an extension and a leading 1; null if there are fewer."""
    d = digits(F.regexp_replace(F.lower(value), r"(x|ext\.?|extension)\s*[0-9]+\s*$", ""))
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, d)


def email_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "^mailto:", "")


def org_key(value: Column) -> Column:
    """Lower-case words without legal forms and "the"."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}&]+", " ")), " "), lambda w: (w != "") & ~w.isin("the", *ORG_SUFFIXES))
    return F.array_join(words, " ")


def joined_org(value: Column) -> Column:
    return F.replace(org_key(value), F.lit(" "), F.lit(""))


def account_key(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[\s\-]", ""))


def bare_digits(value: Column) -> Column:
    """Digits without leading zeros, for values whose separators differ; null under 7 digits."""
    d = digits(value)
    return F.when(F.length(d) >= 7, F.regexp_replace(d, "^0+", ""))


def snippet(text: Column, begin: Column, end: Column, words: int = 6) -> Column:
    """Up to ``words`` words on either side of the span, which stands in brackets."""
    left = F.filter(F.split(F.substr(text, F.lit(1), begin), r"\s+"), lambda w: w != "")
    right = F.filter(F.split(F.substr(text, end + 1, F.length(text)), r"\s+"), lambda w: w != "")
    found = F.concat(F.lit("["), F.substr(text, begin + 1, end - begin), F.lit("]"))
    left = F.when(F.size(left) > words, F.slice(left, -words, words)).otherwise(left)
    return F.array_join(F.concat(left, F.array(found), F.slice(right, 1, words)), " ")


def unglue(value: Column) -> Column:
    """A small letter before a capital, and a letter before a digit run at the end, part again."""
    return F.regexp_replace(F.regexp_replace(value, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"(\p{L})([0-9]+)$", "$1 $2")


def spreadsheet_safe(value: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets an apostrophe in front."""
    return F.when(F.substring(value, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), value)).otherwise(value)


def tidy_filename(stem: Column) -> Column:
    """Separators become one space each."""
    return F.trim(F.regexp_replace(stem, r"[\s_\-.]+", " "))
