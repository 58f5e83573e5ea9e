"""What a candidate must pass: neither a word of its label, nor a figure, nor a number of another kind."""

from __future__ import annotations

import re

from .detectors import ANY_MASK, NO_STREET, STATES, digits, routing
from .labels import DATE, MONTH, NUMBER_WORDS

#: What a label may be followed by without being a value.
JUNK = frozenset((*NUMBER_WORDS, "no.", "of", "the", "is", "was", "for", "and", "to", "in", "on", "n/a", "none", "null", "unknown", "pending", "tbd", "name", "account", "card", "code", "date", "type"))
#: Kinds whose values are decimals by nature; that are never a year; whose values are
#: numbers of accounts, or numbers at all; and that are never masked.
DECIMAL = frozenset(("diagnosis_code", "gps", "ip_address"))
NO_YEAR = frozenset(("bank_account", "investment_account", "masked_account", "loan_number", "policy_number", "claim_number", "check_number", "ssn", "drivers_license"))
ACCOUNTS = frozenset(("bank_account", "investment_account", "masked_account", "loan_number"))
NUMBERS = ACCOUNTS | frozenset(("credit_card", "check_number", "policy_number", "claim_number", "order_number", "tracking_number", "case_number", "routing_number", "drivers_license", "employee_id"))
NEVER_MASKED = frozenset(("check_number", "order_number", "tracking_number", "case_number"))
#: Kinds that a month and year, a range of dates or a date without its year don't belong to.
NO_DATE = NUMBERS | frozenset(("case_designator", "deed_reference", "health_plan", "mrn", "parcel_number", "professional_license", "student_id"))
#: Characters before a value that are looked at, on its own line.
BEFORE = 40

MONEY = re.compile(r"(?:[$€£]\s?)?-?\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|[$€£]\s?-?\d+(?:\.\d{1,2})?|-?\d+\.\d{2}")
_DATE = re.compile(DATE, re.IGNORECASE)
_PART_OF_DATE = re.compile(rf"(?:0?[1-9]|1[0-2])[/-](?:19|20)\d\d|\d{{1,2}}/\d{{1,2}}|{MONTH}\.?[ -]\d{{1,4}}|(?:{DATE})\s?[-–]\s?(?:{DATE})|\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?-\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?", re.IGNORECASE)
_YEAR = re.compile(r"(?:19[5-9]|20[0-4])\d")
_SMALL_DECIMAL = re.compile(r"\d{1,3}\.\d{1,2}")
_ACRES = re.compile(r"\d+(?:\.\d+)?\s*ac(?:re)?s?\b", re.IGNORECASE)
_CUE = re.compile(r"(?:ending(?:\s+in)?|last\s+(?:four|4)(?:\s+digits)?|last\s+digits|\bnos?\.?|\bnumber|\#)\s*[:=–—-]?\s*$", re.IGNORECASE)
_PHONE = re.compile(r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}")
_PHONE_LABEL = re.compile(r"\b(?:tele)?phone|\bcell|\bmobile|\bfax|\btel\b", re.IGNORECASE)
_ACCOUNT_LABEL = re.compile(r"(?:account|acct|a/c|checking|savings|loan|ira)\b\W*(?:(?:number|no|id)\b)?\W*$", re.IGNORECASE)
_REFERENCE_LABEL = re.compile(r"\b(?:check|transaction|ref(?:erence)?|conf(?:irmation)?|trace|order|tracking|auth(?:orization)?|invoice|receipt)\b\W*(?:(?:number|no|id)\b)?\W*$", re.IGNORECASE)
_AFTER_STATE = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(STATES)})\.?,?\s*$")
_LETTER_OR_HYPHEN = re.compile(r"[^\W\d_]|-")
_SAID_HANDLE = re.compile(r"\b(?:handle|user\s?name|user\s?id|cash\s?tag|tag)\b", re.IGNORECASE)


def line_before(text: str, at: int) -> str:
    return text[max(text.rfind("\n", 0, at) + 1, at - BEFORE) : at]


def is_junk(value: str) -> bool:
    """A word of the label, or nothing but signs."""
    return value.lower() in JUNK or not any(c.isalnum() for c in value)


def wrong_shape(category: str, value: str, before: str) -> bool:
    """Money, dates, years, small decimals and acres, where the kind has no such values."""
    if category not in DECIMAL and (MONEY.fullmatch(value) or _SMALL_DECIMAL.fullmatch(value)):
        return True
    if category == "parcel_number" and _ACRES.match(value):
        return True
    if category == "dob" or _CUE.search(before):
        return False
    if _DATE.fullmatch(value):
        return True
    return (category in NO_YEAR and bool(_YEAR.fullmatch(value))) or (category in NO_DATE and bool(_PART_OF_DATE.fullmatch(value)))


def other_number(category: str, value: str, before: str, line: str) -> bool:
    """A number that its form or its line shows to be of another kind."""
    masked = ANY_MASK.search(value) is not None
    if category in NEVER_MASKED and masked:
        return True
    if category not in NUMBERS:
        return False
    owned = category in ACCOUNTS and _ACCOUNT_LABEL.search(before)
    if not owned and (_PHONE.fullmatch(value) or (len(digits(value)) == 10 and _PHONE_LABEL.search(before))):
        return True
    if category not in ACCOUNTS or masked:
        return False
    if re.fullmatch(r"\d{5}(?:-\d{4})?", value) and _AFTER_STATE.search(before):
        return True
    if "routing" in line.lower() and not owned and routing(value):
        return True
    return not owned and bool(_REFERENCE_LABEL.search(before))


def cut_from_number(text: str, begin: int, end: int) -> bool:
    """The head or tail of a longer figure; a value with a letter or a hyphen is whole."""
    value = text[begin:end]
    if _LETTER_OR_HYPHEN.search(value):
        return False
    after, before = text[end : end + 5], text[max(0, begin - 2) : begin]
    if value[-1:].isdigit() and re.match(r"\.\d|,\d{3}(?!\d)", after):
        return True
    if not value[:1].isdigit() or not before[:1].isdigit():
        return False
    return before[1:] == "." or (before[1:] == "," and bool(re.match(r"\d{3}(?!\d)", value)))


def is_handle(value: str, between: str) -> bool:
    """A payment handle: with a sign of one, or after a word for one and no word of prose; on another line
    than its label only with a sign or at least six small letters."""
    signed = value[0] in "@$" or bool(re.search(r"[0-9._-]|[a-z][A-Z]", value))
    if signed:
        return True
    word = value.lower()
    if word in JUNK or word in NO_STREET or not _SAID_HANDLE.search(between) or len(value) < 4:
        return False
    return "\n" not in between or (value.islower() and len(value) >= 6)


def is_site_handle(value: str, between: str) -> bool:
    """A handle at a site: with a sign of one, or after a colon, an equals sign or a word for one."""
    if value[0] == "@" or re.search(r"[0-9_]|[a-z][A-Z]|[a-z][.-][a-z]", value):
        return True
    return value.lower() not in JUNK | NO_STREET and bool(re.search(r"[:=]|\b(?:handle|profile|user\s?name|id)\b", between, re.IGNORECASE))


def own_line(text: str, begin: int, end: int) -> int:
    """Where an address ends that goes on to the next line: a street that doesn't open its line keeps to
    it, unless the town stands alone on the next or a label ends right before the street."""
    first = text.find("\n", begin, end)
    if first < 0:
        return end
    line = text[text.rfind("\n", 0, begin) + 1 : begin]
    if not line.strip() or re.search(r":\s*$", line):
        return end
    rest = text[end : (text.find("\n", end) + 1 or len(text) + 1) - 1]
    return end if not rest.strip(" \t.,") else first
