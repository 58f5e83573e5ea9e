"""Invented names in the shape of the real ones they stand for, and keys that values are compared by."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .names import Name, _key, parse
from .validators import digits


def render(made: Name, like: str, real: Name) -> str:
    """The invented name in the shape of a written form of the real one: the same parts, initials where those
    are initials, last name first where it is, the same case, plural and title."""
    words = re.findall(r"[\w'’-]+\.?|,", like)
    table = {_key(real.first): made.first} | {_key(w): made.last for w in (real.last, real.last.split()[-1] if real.last else "") if w}
    table |= {_key(m): (made.middles[i] if i < len(made.middles) else "") for i, m in enumerate(real.middles)}
    first_letters = {k[:1]: v for k, v in reversed(list(table.items())) if k}
    out = []
    for w in words:
        k = _key(w)
        if w == ",":
            out.append(",")
        elif k in table:
            out.append(_cased(table[k], w))
        elif k.endswith("s") and k[:-1] in table:  # the Smiths
            plural = table[k[:-1]] + ("es" if re.search(r"(s|x|z|ch|sh)$", table[k[:-1]]) else "s")
            out.append(_cased(plural, w))
        elif len(k) == 1 and k in first_letters and first_letters[k]:
            out.append(_cased(first_letters[k][0], w) + ("." if w.endswith(".") else ""))
        else:
            out.append(w)
    return re.sub(r"\s+,", ",", " ".join(x for x in out if x))


def _cased(new: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new.lower() if letters and all(c.islower() for c in letters) else new


def shaped(partial: str, real: str, made: str) -> str | None:
    """What stands for a shorter or run-together form of a name: its parts mapped one by one; None if a part is
    not one of the name's."""
    name, new = parse(real), parse(made)
    parts = {_key(name.first), *map(_key, name.middles), *(_key(w) for w in name.last.split())}
    words = [_key(w) for w in re.findall(r"[\w'’-]+", partial)]
    if all(w in parts or (len(w) == 1 and w in {p[:1] for p in parts}) for w in words):
        return render(new, partial, name)
    glued = "".join(words)
    whole = [(_key(name.first), new.first), *((_key(m), new.middles[i] if i < len(new.middles) else "") for i, m in enumerate(name.middles)), (_key(name.last), new.last)]
    for some in (whole, [whole[0], whole[-1]], [whole[-1], whole[0]]):
        if len(glued) >= 6 and glued == "".join(k for k, _ in some):
            return _cased("".join(v for _, v in some), partial)
    return None


def surname_swapped(business: str, real_last: str, made_last: str) -> str:
    """A business's name with the family's invented last name in place of the real one, also in the plural or
    the genitive."""
    def put(m: re.Match) -> str:
        return _cased(made_last, m[1]) + (m[2] or "")

    return re.sub(rf"(?<!\w)({re.escape(real_last)})(s|['’]s|s['’])?(?!\w)", put, business, flags=re.IGNORECASE)


def company_pattern(name: str) -> str:
    """A pattern for every written form of a company: with or without "the", legal forms and apostrophes, "&" for
    "and", any punctuation. A name of two words matches as it is written, in capitals or with capitals only, as
    its words may be prose. Null (empty) if fewer than two words or six letters are left."""
    core = [w for w in re.findall(r"[\w&]+(?:['’]\w+)?", name) if w.lower() not in ("the", *X.ORG_SUFFIXES)]
    if len(core) < 2 or sum(c.isalpha() for w in core for c in w) < 6:
        return ""

    def body(w: str) -> str:
        if w.lower() in ("&", "and"):
            return r"(?:&|(?i:and))"
        plain = re.escape(re.sub("['’]", "", w))
        return plain if not re.search("['’]", w) else re.sub(r"(?=s$)", "['’]?", plain, flags=re.IGNORECASE)

    join = r"[\s.,]+"
    forms = [join.join(body(w) for w in core)]
    if len([w for w in core if w.lower() not in ("&", "and")]) > 2:
        inner = f"(?i:{forms[0]})"
    else:
        forms += [join.join(body(w.upper()) for w in core), join.join(body(w.capitalize()) for w in core)]
        inner = "(?:" + "|".join(dict.fromkeys(forms)) + ")"
    tails = "|".join(sorted(X.ORG_SUFFIXES, key=len, reverse=True))
    return rf"(?<!\w)(?:(?i:the)\s+)?{inner}(?:[\s.,]+(?i:{tails})\b\.?)*(?!\w)"


def value_key(kind: Column, value: Column) -> Column:
    """The form by which values of a kind are equal: digits of numbers, the last ten of phones, lower-case
    addresses of mail, names without signs; empty where nothing is left."""
    d = digits(value)
    return (
        F.when(kind.isin("ssn", "tin", "account", "card", "ein"), F.regexp_replace(d, "^0+", ""))
        .when(kind.isin("phone", "fax"), F.when(F.length(d) >= 10, F.substr(d, F.length(d) - 9, F.lit(10))).otherwise(d))
        .when(kind == "email", X.email_key(value))
        .when(kind.isin("employer", "business", "organization"), X.org_key(value))
        .when(kind.isin("handle", "username"), F.regexp_replace(F.lower(F.trim(value)), r"^[@$]", ""))
        .when(kind.isin("vin", "dl", "passport", "plate"), F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")))
        .otherwise(F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]+", " ")))
    )
