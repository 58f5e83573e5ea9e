"""Labelled values: the words that name a value, what may stand between them and it, and its shape.

All labels are found by one pattern, a tree of their common beginnings, in a single pass over a text.
Where a label ends, the rules of its categories read on: links such as "number" or "ending in", a
sign, and the value, which must have the rule's shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

# -- shapes of values -------------------------------------------------------------------------
#: What hides digits; runs of it with one hyphen or space between, then the 2 to 6 digits
#: that are left and are no cents; or those digits first.
MASK = r"(?:[Xx*•#]{2,}+|\.{2,4})"
MASKED = rf"(?:{MASK}(?:[- ]{MASK})*[- ]?\d{{2,6}}(?!\d|[.,]\d)|(?<![\d.,$])\d{{2,6}}[- ]?{MASK}(?:[- ]{MASK})*)"
#: 3 to 30 letters, digits, hyphens, slashes and stops, a digit among them.
ANY_ID = r"(?:(?=[A-Za-z0-9][A-Za-z0-9\-/.]*\d)[A-Za-z0-9][A-Za-z0-9\-/.]{2,29})"
#: Two to five groups of 3 to 6 digits.
GROUPED = r"(?:\d{3,6}(?:[- ]\d{3,6}){1,4}(?!\d|[.,]\d))"
#: 13 to 19 digits in one run, in fours, or as 4, 6 and 5.
CARD = r"(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})"

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
MONTH = "(?:" + "|".join(rf"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + "|Sept)"
DATE = "(?:" + "|".join([r"\d{4}[/.-]\d{1,2}[/.-]\d{1,2}", r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}", rf"{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}", rf"\d{{1,2}}\s+{MONTH}\.?,?\s+\d{{4}}"]) + ")"
#: A capital letter whatever the case that the rest of a pattern ignores.
_CAPITAL = r"(?-i:[A-Z][\w'-]*)"

SHAPES = {
    "identifier": rf"(?:{MASKED}|{ANY_ID})",
    "account": rf"(?:{MASKED}|{GROUPED}|{ANY_ID})",
    "long number": r"\d{2,4}(?:[- ]?\d{3,8})(?:[- ]\d{2,6})?(?![\d.,])",
    "digits": r"\d{8,20}(?!\d)",
    "ten digits": r"\d{10}(?!\d)",
    "phone": r"(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]?\d{4}",
    "social security": rf"(?:\d{{3}}[- ]?\d{{2}}[- ]?\d{{4}}(?!\d)|{MASKED})",
    "tax": rf"(?:\d{{2}}-?\d{{7}}(?!\d)|[A-Z]{{0,2}}-?\d{{2,10}}(?:-\d{{2,4}})?(?!\d)|{MASKED})",
    "code of a diagnosis": r"[A-TV-Z]?\d{2,5}(?:\.\d{1,4})?(?![\w])",
    "card": rf"(?:{MASKED}|{CARD}(?!\d)|\d-\d{{4,5}}(?!\d)|(?<!\d)\d{{4}}(?!\d|[-/.]\d))",
    "bank code": r"(?-i:[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)(?![A-Za-z0-9])",
    "user name": r"[A-Za-z0-9._@-]{3,40}",
    "handle": r"[$@]?[A-Za-z][A-Za-z0-9._-]{2,39}",
    "plate": r"(?-i:[A-Z0-9]{1,4}[- ][A-Z0-9]{3,5}|[A-Z0-9]{3,9})(?![\w-])",
    "title": r"(?=[A-Z0-9-]*\d)[A-Z0-9][A-Z0-9-]{4,17}",
    "case": r"(?=[A-Za-z0-9\-:/.]*\d)[A-Za-z0-9][A-Za-z0-9\-:/.]{3,28}[A-Za-z0-9]",
    "order": r"(?=[A-Z0-9-]*\d)[A-Z0-9][A-Z0-9-]{5,28}[A-Z0-9](?![\w-])",
    "shipment": r"(?=[A-Z0-9]*\d)[A-Z0-9]{8,34}(?![\w-])",
    "date": DATE,
    "place": rf"{_CAPITAL}(?:\s+{_CAPITAL}){{0,3}}(?:,\s*{_CAPITAL}(?:\s+{_CAPITAL}){{0,3}}){{0,2}}",
}


# -- what names them --------------------------------------------------------------------------
@dataclass(frozen=True)
class Rule:
    """``labels`` name a value by themselves, ``numbered`` ones only before a word for "number". A word
    in capitals is an abbreviation, whose letters may be parted by full stops."""

    category: str
    priority: int
    labels: tuple[str, ...] = ()
    numbered: tuple[str, ...] = ()
    shape: str = "identifier"
    link: str = "loose"


PAYMENT_APPS = ("paypal", "pay pal", "venmo", "cash app", "cashapp", "zelle", "square cash", "apple pay", "google pay", "wise", "revolut", "chime", "stripe", "coinbase", "robinhood")

#: Labels of each category, and the priority of what they name.
RULES = (
    Rule("fax", 95, ("fax", "facsimile", "faxsimile", "telecopier"), shape="phone"),
    Rule("phone", 93, ("phone", "telephone", "cell", "cellular", "mobile", "tel"), shape="ten digits"),
    Rule("username", 70, ("user name", "user id", "login", "login name", "login id", "screen name", "display name"), shape="user name"),
    Rule("ssn", 96, ("SSN", "ITIN", "social security", "soc sec", "individual taxpayer identification"), shape="social security"),
    Rule("ein", 94, ("EIN", "FEIN", "TIN", "PTIN", "employer identification", "employer id", "taxpayer identification", "taxpayer id", "tax id", "federal tax id", "state identification", "state id", "state employer"), ("entity",), "tax"),
    Rule("drivers_license", 90, ("DL", "driver's license", "driver license", "driver's licence", "operator's license", "operator license", "state id card", "state identification card")),
    Rule("passport", 90, ("passport",)),
    Rule("alien_number", 89, ("alien", "alien registration", "a-number", "USCIS", "visa", "i-94")),
    Rule("military_id", 88, ("military id", "military service", "dod id", "service number", "EDIPI")),
    Rule("inmate_number", 88, ("inmate", "booking", "offender", "prisoner", "doc id", "jail id")),
    Rule("student_id", 86, ("student", "student id", "pupil id", "school id", "enrollment")),
    Rule("employee_id", 85, ("employee", "badge"), ("emp", "payroll", "associate", "personnel")),
    Rule("voter_id", 86, ("voter", "voter id", "voter registration")),
    Rule("bar_number", 86, ("state bar", "utah bar", "attorney", "attorney registration"), ("bar",)),
    Rule("notary_id", 86, ("notary", "notary public", "notary commission"), ("commission",)),
    Rule("professional_license", 84, ("license", "licence", "NPI", "CRD", "IARD"), ("certification", "registration")),
    Rule("tribal_id", 86, ("tribal id", "tribal enrollment", "tribal membership", "CDIB", "certificate of degree of indian blood"), ("enrollment",)),
    Rule("mrn", 90, ("MRN", "medical record", "health record"), ("patient", "chart")),
    Rule("health_plan", 88, ("health plan", "insurance id", "medicaid", "medicare", "HICN", "MBI"), ("member", "subscriber", "group")),
    Rule("diagnosis_code", 88, ("ICD", "icd-9", "icd-10", "icd code", "CPT", "cpt code", "DSM", "dsm-5", "HCPCS", "diagnosis code"), shape="code of a diagnosis"),
    Rule("prescription", 86, ("prescription", "RX", "NDC")),
    Rule("credit_card", 92, ("card", "credit card", "debit card", "visa", "mastercard", "master card", "amex", "american express", "discover"), shape="card"),
    Rule("routing_number", 91, ("routing", "ABA", "RTN", "transit")),
    Rule("swift", 90, ("SWIFT", "BIC", "swift/bic", "swift code", "bic code"), shape="bank code"),
    Rule("check_number", 90, PAYMENT_APPS[:7], shape="digits"),
    Rule("payment_handle", 89, PAYMENT_APPS, shape="handle"),
    Rule("investment_account", 87, ("401(k)", "401k", "403(b)", "403b", "457", "529", "IRA", "roth", "roth ira", "TSP", "HSA", "pension", "annuity", "brokerage", "participant", "mutual fund", "retirement account", "retirement plan", "investment account", "securities account"), ("plan", "contract"), "account"),
    Rule("investment_account", 86, ("individual", "joint", "JTWROS", "TOD", "trust", "custodial", "UTMA", "UGMA", "roth ira", "traditional ira", "rollover ira", "sep ira", "simple ira", "inherited ira"), shape="long number", link="tight"),
    Rule("bank_account", 82, ("account", "acct", "a/c", "bank account", "checking", "checking account", "savings", "savings account", "deposit account", "money market", "certificate of deposit", "CD", "share certificate", "meter", "service account"), ("service",), "account", "strict"),
    Rule("bank_account", 82, ("account", "acct", "a/c"), shape="account", link="said"),
    Rule("loan_number", 86, ("loan", "mortgage", "escrow", "deed of trust", "HELOC", "line of credit", "promissory note"), ("note",), "account"),
    Rule("policy_number", 86, ("policy", "policies", "insurance policy", "certificate of insurance"), ("coverage",)),
    Rule("claim_number", 86, ("claim", "adjuster file")),
    Rule("check_number", 80, ("check", "cheque", "draft", "wire", "wire transfer", "wire confirmation", "wire reference", "invoice", "transaction", "confirmation", "receipt", "ref", "authorization code", "auth code"), ("reference", "trace", "auth")),
    Rule("order_number", 83, ("order", "purchase order"), ("PO",), "order"),
    Rule("tracking_number", 83, ("tracking", "waybill", "airbill", "air bill"), ("shipment",), "shipment"),
    Rule("parcel_number", 88, ("APN", "parcel", "assessor's parcel", "assessor parcel", "tax parcel", "property id", "sidwell"), ("pin",)),
    Rule("deed_reference", 86, (), ("entry", "instrument", "recording", "document", "reception")),
    Rule("vin", 89, ("VIN", "vehicle identification")),
    Rule("license_plate", 88, ("license plate", "licence plate", "registration plate"), ("plate", "tag"), "plate"),
    Rule("license_plate", 87, ("plate",), shape="plate", link="tight"),
    Rule("vehicle_title", 88, ("certificate of title",), ("vehicle title", "title"), "title"),
    Rule("vessel_number", 88, ("HIN", "hull", "hull id", "hull identification", "aircraft", "aircraft registration", "boat registration"), ("tail", "vessel", "boat")),
    Rule("safe_deposit", 88, ("safe deposit", "safe deposit box", "safety deposit", "safety deposit box", "vault box")),
    Rule("storage_unit", 86, ("storage unit", "storage locker")),
    Rule("case_number", 93, ("case", "civil case", "criminal case", "civil", "criminal", "docket", "cause", "court file", "matter", "index", "action", "file", "probate", "juvenile", "adversary", "appellate", "appeal"), shape="case"),
    Rule("case_designator", 80, ("bar code", "e-filed document"), ("tracking", "efiling", "envelope", "submission")),
    Rule("dob", 95, ("DOB", "date of birth", "birth date", "birthday", "date born"), shape="date"),
    Rule("dob", 94, ("born", "born on"), shape="date"),
    Rule("pob", 92, ("birthplace", "place of birth", "city of birth", "state of birth", "country of birth", "born in", "born at"), shape="place"),
)

#: Words for "number"; others that may stand between a label and its value ("to" and
#: "from" may not); and those that may in the title of a bank account.
NUMBER_WORDS = ("number", "num", "no", "nos", "id", "identification", "identifying")
LAST_DIGITS = ("ending", "ending in", "last digits", "last 4", "last 4 digits", "last four", "last four digits")
LINK_WORDS = (
    "account", "acct", "handle", "profile", "user name", "username", "login", "tag", "cashtag", "is", "are", "was", "were", "of", "for", "at", "with", "payment", "pmt", "transfer",
    "transaction", "ref", "reference", "posted", "school", "record", "primary", "current", "assigned",
)


def _signs(label: str) -> list[str]:
    """A piece of pattern for each sign of a label."""
    out = []
    for i, word in enumerate(label.split()):
        if i:
            out.append(r"\.?[\s_-]+")
        for ch in word:
            out.append({"'": "['’]?", "-": r"[\s-]?"}.get(ch, re.escape(ch.lower())))
            if word.isalpha() and word.isupper():
                out.append(r"\.?")
    return out


def tree(labels: Iterable[str]) -> str:
    """A pattern of all labels that branches where they differ and prefers the longest."""
    root: dict = {}
    for label in sorted(labels):
        node = root
        for sign in _signs(label):
            node = node.setdefault(sign, {})
        node[""] = {}

    def write(node: dict) -> str:
        parts = [sign + write(rest) for sign, rest in sorted(node.items(), key=lambda x: x[0] == r"\.?") if sign]  # words before abbreviations
        if not parts:
            return ""
        return f"(?:{'|'.join(parts)}){'?' if '' in node else ''}" if len(parts) > 1 or "" in node else parts[0]

    return write(root)


def folded(label: str) -> str:
    return re.sub(r"[\s._'’-]+", "", label).lower()


_NUMBER = rf"(?:(?:{tree(NUMBER_WORDS)})\.?(?![A-Za-z0-9])|\#)"
_PIECE = rf"(?:(?:{tree((*NUMBER_WORDS, *LAST_DIGITS, *LINK_WORDS))})\.?(?![A-Za-z0-9])|[#|/]|\([^()\n]{{1,30}}\))\s*+"
_TITLE_PIECE = rf"(?:(?:{tree((*NUMBER_WORDS, *LAST_DIGITS))})\.?(?![A-Za-z0-9])|[#/]|\([^()\n]{{1,30}}\))\s*+"
LINKS = {
    "loose": rf"\.?\)?\s*+(?:{_PIECE}){{0,6}}(?:[:=#–—-]{{1,2}}\s*+)?",
    "strict": rf"\.?\s*+(?:{_TITLE_PIECE}){{0,4}}(?:[:=#–—-]{{1,2}}\s*+)?",
    "said": rf"\.?[^\S\n]*+(?:{_NUMBER}[^\S\n]*+)?(?:is|was)[^\S\n]*+[:#]?[^\S\n]*+",
    "tight": r"[^\S\n]*+[:#–-]?[^\S\n]*+",
}
#: Neither inside a word nor after a digit, save where a capital follows a small letter.
_BEGIN = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z])(?=[A-Z])))"
#: Not before a small letter, nor in the middle of a run of capitals (a mask of X may follow) or digits.
_END = r"s?(?-i:(?![a-z])(?!(?<=[A-Z])[A-WYZ]))(?:(?<![0-9])|(?![0-9]))"


#: Shapes that need no digit.
WORDY = frozenset(("bank code", "handle", "place", "plate", "user name"))


@dataclass(frozen=True)
class Plan:
    """The pattern of all labels of some categories, those of values without and with a digit apart, and the
    rules of each."""

    pattern: re.Pattern
    wordy: re.Pattern
    digital: re.Pattern
    hint: str
    rules: dict[str, list[tuple[Rule, re.Pattern]]]


@lru_cache(maxsize=64)
def plan(categories: frozenset[str] | None) -> Plan | None:
    """What finds the labelled values of the categories (None: of all)."""
    rules: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    labels = []
    for rule in RULES:
        if categories is not None and rule.category not in categories:
            continue
        for names, before in ((rule.labels, ""), (rule.numbered, rf"\.?\s*+{_NUMBER}")):
            value = re.compile(f"{before}{LINKS[rule.link]}({SHAPES[rule.shape]})", re.IGNORECASE) if names else None
            for name in names:
                labels.append(name)
                rules.setdefault(folded(name), []).append((rule, value))
    if not labels:
        return None
    body = tree(labels)
    kinds = [[x for x in labels if any((r.shape in WORDY) == wordy for r, _ in rules[folded(x)])] for wordy in (True, False)]
    patterns = [re.compile(f"{_BEGIN}{tree(some)}{_END}" if some else r"(?!)", re.IGNORECASE) for some in (labels, *kinds)]
    return Plan(*patterns, f"(?i)(?:{body})", rules)


def find(text: str, some: Plan, digits: bool, places: Iterable[tuple[int, int]]) -> Iterator[tuple[Rule, int, int, int]]:
    """(rule, where its label ends, begin and end of the value) of every labelled value with a digit, or of those
    whose shape needs none, whose labels stand in these places."""
    for start, end in places:
        for m in (some.digital if digits else some.wordy).finditer(text, start, end):
            key = folded(m[0])
            for rule, value in some.rules.get(key) or some.rules.get(key.removesuffix("s"), ()):
                if (rule.shape not in WORDY) == digits and (v := value.match(text, m.end())):
                    yield rule, m.end(), *v.span(1)
