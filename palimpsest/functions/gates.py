"""What may be a person, a business, an address or a name worth proposing."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .addresses import SUFFIXES
from .names import NICKNAMES, _key

#: Words of a business's name at its end, and institutions whose names stay as they are.
BUSINESS_TAILS = frozenset("associates bakery cafe center centre clinic co company construction corp corporation dental enterprise enterprises foundation group holdings inc incorporated landscaping limited llc llp ltd partners pllc plc properties repair restaurant school services shop solutions store studio supply systems technologies trust".split())
INSTITUTIONS = frozenset("bank banking capital county court credit federal finance financial fund insurance lender lending loan mortgage servicing state union university".split())
#: Words of accounts and payments, of roles in a case, and of forms, that no person's name has.
ACCOUNT_WORDS = frozenset("account acct ach atm autopay balance card cash cashout check checking confirmation credit debit deposit draft everyday fee funding interest money online payment payroll purchase ref reference refund savings transfer withdrawal wire".split())
ROLE_WORDS = frozenset("appellant appellee attorney borrower child claimant clerk commissioner counsel creditor debtor defendant father guardian husband judge mother petitioner plaintiff respondent spouse wife witness".split())
FORM_WORDS = frozenset("act add amount activity address agreement code column date description due exhibit filed form maturity name note number order page paid posting rate rule section settings statement status street summary tax taxes telephone total tran transaction type usa".split())
#: Services that move money, and brands that statements print, which are no people.
RAILS = frozenset("amazon applepay cashapp chime coinbase costco doordash ebay etsy fdic google netflix paypal spotify square stripe uber venmo walmart zelle".split())
FUNCTION_WORDS = frozenset("a an and as at but by for from he her his i if in is it its me my no not of on or our she so that the their they this to up us was we were who will with you your".split())
#: Names that are everyday words and stand alone only with a capital.
RISKY_WORDS = frozenset("art bill dawn dean faith frank grace hope jack joy june king long mark may page price rich rose summer will young".split())
#: Words that a name of at most so many holds.
MOST_WORDS = 5
_MASK = re.compile(r"[*•#]|\bx{3,}\b", re.IGNORECASE)
_ADDRESS = re.compile(rf"^\s*\d+[A-Za-z]?\s+(?:[NSEW]\.?\s+)?(?:\d+\s+[NSEW]\b|.*\b(?:{'|'.join(SUFFIXES)})\b)|\bP\.?\s?O\.?\s+Box\b", re.IGNORECASE)


_APART = re.compile(r"[^\w'’&-]+")
_NO_PERSON = BUSINESS_TAILS | INSTITUTIONS | ACCOUNT_WORDS | ROLE_WORDS | FORM_WORDS | RAILS | FUNCTION_WORDS


def words(text: str) -> list[str]:
    return [w for w in map(_key, _APART.split(text or "")) if w]


def is_address(text: str) -> bool:
    return bool(_ADDRESS.search(text or ""))


def is_business(name: str) -> bool:
    return bool(set(words(name)[1:]) & BUSINESS_TAILS)


def without_tail(name: str) -> str:
    """The name without words of accounts and payments at its end, two words at least."""
    parts = (name or "").split()
    while len(parts) > 2 and _key(parts[-1]) in ACCOUNT_WORDS:
        parts.pop()
    return " ".join(parts)


def ordinary(word: str) -> bool:
    """A word that is no name by itself."""
    k = _key(word)
    return k in FUNCTION_WORDS or k in FORM_WORDS or k in ACCOUNT_WORDS or k in ROLE_WORDS


def acceptable_person(name: str) -> bool:
    """Without digits, masks, and words of organisations, accounts, roles and forms; a single word of at least
    four letters; no address."""
    w = words(name)
    if not w or any(c.isdigit() for c in name) or _MASK.search(name) or is_address(name):
        return False
    if not _NO_PERSON.isdisjoint(w):
        return False
    return len(w) <= MOST_WORDS and (len(w) > 1 or len(w[0]) >= 4)


def holds_name(value: str, parts: Collection[str]) -> bool:
    """Whether a web address or a handle holds a part of a name: of four letters and more anywhere, a shorter
    one as a word of its own."""
    low = (value or "").lower()
    apart = set(re.split(r"[^a-z]+", low))
    return any((len(p) >= 4 and p in low) or p in apart for p in (_key(x) for x in parts) if len(p) >= 2)


def likely_name(text: str, category: str = "person", known: Collection[str] = (), places: Collection[str] = (), given: Collection[str] = ()) -> bool:
    """Whether a proposal is probably a name: it shares a known word; else it ends in no word of a form, is no
    organisation or place (employers are taken as they come), is no service or brand, and begins with a given
    name or holds a word that is not ordinary."""
    w = words(text)
    if not w:
        return False
    if set(w) & {_key(k) for k in known}:
        return True
    if w[-1] in FORM_WORDS or set(w) & RAILS:
        return False
    if category == "employer":
        return True
    if category in ("organization", "location") or " ".join(w) in {" ".join(words(p)) for p in places}:
        return False
    if w[0] in given or w[0] in NICKNAMES or any(w[0] in shorts.split() for shorts in NICKNAMES.values()):
        return True
    return not all(ordinary(x) for x in w) and acceptable_person(text)


def worth_proposing(value: str, category: str = "person") -> bool:
    """Long enough, of few words, and neither a form's word alone nor a piece of a mask or a number."""
    w = words(value)
    if not w or len(w) > MOST_WORDS or len(value.strip()) < 3 or _MASK.search(value):
        return False
    if sum(c.isdigit() for c in value) * 2 > sum(c.isalnum() for c in value):
        return False
    if category == "person" and (len(w) == 1 and len(w[0]) < 4 or any(c.isdigit() for c in value)):
        return False
    return not all(ordinary(x) for x in w)


def screen(says_name: bool | None, parsed: str | None) -> str:
    """What two readers make of a proposal: "other" only if both say that it is no person; a reader that does
    not answer says nothing against it."""
    return "other" if says_name is False and parsed not in ("person", None, "") else "person"


def keeps(text: str, category: str, label: str | None) -> bool | None:
    """Whether a proposal stays ticked after screening: employers and a given with a last name do, what ends in a
    form's word does not; None where there is no label."""
    w = words(text)
    if w and w[-1] in FORM_WORDS:
        return False
    if label is None:
        return None
    if label == "person" or category == "employer":
        return True
    return len(w) == 2 and acceptable_person(text)


def as_column(f: Callable[..., object], kind: T.DataType) -> Callable[..., Column]:
    """A function of values as one of columns, whole Arrow batches at a time; a null comes as an empty text."""

    @F.pandas_udf(kind)
    def apply(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*(x if x is not None else "" for x in row)) for row in zip(*cols, strict=True)], dtype=object)

    return apply


#: The gates on columns; null counts as empty.
is_address_col = as_column(is_address, T.BooleanType())
is_business_col = as_column(is_business, T.BooleanType())
without_tail_col = as_column(without_tail, T.StringType())
acceptable_person_col = as_column(acceptable_person, T.BooleanType())
worth_proposing_col = as_column(worth_proposing, T.BooleanType())
ordinary_col = as_column(ordinary, T.BooleanType())


def likely_name_col(text: Column, category: Column, known: Collection[str] = (), places: Collection[str] = (), given: Collection[str] = ()) -> Column:
    """``likely_name`` on columns, with word lists of a case, some tens of words each."""
    return as_column(lambda t, c: likely_name(t, c, known, places, given), T.BooleanType())(text, category)


def holds_name_col(value: Column, parts: Collection[str]) -> Column:
    return as_column(lambda v: holds_name(v, parts), T.BooleanType())(value)
