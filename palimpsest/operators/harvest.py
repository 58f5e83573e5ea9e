"""Proposals from context: parties, officials, children, places, other parties of payments, employers, holders.

Each harvester is a set of readings of one text; a reading yields a kind, a value, how sure it is and
where it stands. What context proposes a gazetteer or a classifier may confirm and known names veto.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gates import FORM_WORDS, INSTITUTIONS, RAILS, acceptable_person, is_address, is_business, without_tail, words
from ..functions.names import plausible
from .detectors import STATES

Proposal = tuple[str, str, str, int]  # kind, value, confidence, begin

#: Words that make a run of capitals no name.
BOILERPLATE = frozenset("and at case commissioner county court defendant district exhibit idaho in judge judicial matter marriage motion nevada number of order petitioner plaintiff re respondent statement state the utah".split())
_PERSONS = frozenset(("party", "former", "official", "child", "counterparty", "cardholder", "holder", "person", "receiver", "feed"))
_RANK = {"high": 3, "medium": 2, "low": 1}

_WORD = r"(?:[A-Z]\.|[A-Z][\w'’-]*)"
#: Words with one space between them; a wider gap is a column's.
_NAME = rf"(?:[A-Z][\w'’-]+|[A-Z]\.(?=[ \t]))(?:[ \t]{_WORD}){{0,4}}"
_ROLE = r"(?:Petitioner|Respondent|Plaintiff|Defendant|Appellant|Appellee|PETITIONER|RESPONDENT|PLAINTIFF|DEFENDANT)"
_TITLE = r"(?:Magistrate Judge|District Court Judge|Chief Justice|Hearing Officer|(?:District )?Court Commissioner|Commissioner|Magistrate|Referee|Justice|Judge|Honorable|Hon\.)"
_STATE = "(?:" + "|".join(STATES) + ")"
_DATE = r"(?:\d{1,2}/(?:\d{1,2}/)?(?:\d{4}|\d{2})|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+(?:\d{1,2},\s+)?\d{4})"
_RAIL = r"(?:ZELLE|VENMO|CASH APP|PAYPAL|ONLINE TRANSFER|WIRE|TRANSFER|Zelle|Venmo|Cash App|PayPal|Online Transfer|Wire|Transfer)"
_UPPER_NAME = rf"{_NAME}"

#: (kind, confidence, pattern): group 1 is the value. The parts of a case's papers.
CAPTIONS = (
    ("party", "high", rf"^[ \t]*({_NAME}),?[ \t]*\n?[ \t]*{_ROLE}\b"),
    ("party", "medium", rf"\b{_ROLE}:?[ \t]+({_NAME})"),
    ("party", "high", rf"IN THE MATTER OF THE (?:MARRIAGE|PARENTAGE) OF:?\s+({_NAME})"),
    ("party", "high", rf"IN THE MATTER OF THE (?:MARRIAGE|PARENTAGE) OF:?\s+{_NAME}\s+(?:and|AND)\s+({_NAME})"),
    ("former", "high", rf"(?:formerly known as|f/k/a|a/k/a|also known as|n[eé]e)[ \t]+({_NAME})"),
)
OFFICIALS = (
    ("official", "high", rf"\b(?:Assigned )?{_TITLE}:?[ \t]+({_NAME})"),
    ("official", "high", rf"^[ \t]*({_NAME}),[ \t]+(?:\w+ )?(?:District |Circuit )?(?:Court )?(?:Judge|Commissioner)\b"),
    ("official", "high", rf"^[ \t]*({_NAME})[ \t]*\n[ \t]*(?:DISTRICT COURT |District Court |Court |COURT )(?:JUDGE|Judge|COMMISSIONER|Commissioner)\b"),
    ("official", "medium", rf"(?i:by the court|recommended by the (?:court )?commissioner|commissioner['’]s recommendation):?[ \t]*\n(?:[ \t_]*\n){{0,5}}[ \t]*(?:/s/[ \t]*)?({_NAME})[ \t]*(?:\n|$)"),
    ("official", "medium", rf"\b({_NAME}),?[ \t]+Clerk of (?:the )?Court"),
)
CHILDREN = (
    ("child", "high", rf"({_NAME})[ \t]+\(?(?:Born|born|DOB|d\.o\.b\.)[: \t]+{_DATE}"),
    ("child", "medium", rf"\bminor child(?:ren)?,?(?: named)?:?[ \t]+({_NAME})"),
    ("child", "medium", rf"\bcustody of (?:the )?(?:parties['’] )?(?:minor )?child(?:ren)?,?[ \t]+({_NAME})"),
)
_TOWN = r"[A-Z][\w'’]+(?:[ \t](?:of|or|d['’]|de|la|[A-Z][\w'’]*)){0,4}"
PLACES = (
    ("place", "medium", rf"\b(?:resides? in|residing in|resident of|lives? in|living in)[ \t]+({_TOWN})"),
    ("place", "medium", rf"\b(?:moved|relocated|returned) to[ \t]+({_TOWN})"),
    ("place", "medium", rf"\b(?:is )?(?:located|married|born|employed) (?:in|at)[ \t]+({_TOWN})"),
    ("place", "high", rf"^[ \t]*({_TOWN}),?[ \t]+{_STATE}\.?[ \t]+\d{{5}}(?:-\d{{4}})?[ \t]*\.?$"),
    ("place", "medium", rf"(?:,|\bin|\bof|\bto)[ \t]+({_TOWN}),[ \t]+{_STATE}\b"),
)
PAYMENTS = (
    ("counterparty", "high", rf"\b{_RAIL}\b(?:[ \t]+(?:payment|PAYMENT|PMT))?[ \t]+(?:to|from|TO|FROM)[ \t]+({_NAME})"),
    ("counterparty", "high", rf"\b(?:ZELLE|Zelle)[ \t]+(?:CREDIT|DEBIT|Credit|Debit)?[ \t]*({_NAME})"),
    ("counterparty", "medium", rf"\b(?:CHECK|Check)[ \t]+#?\d+[ \t]+(?:TO|to)[ \t]+({_NAME})"),
    ("counterparty", "medium", rf"\b(?:ACH|ach)[ \t]+(?:PMT|PAYMENT|Payment|pmt)[ \t]+(?:FROM|TO|from|to)[ \t]+({_NAME})"),
    ("counterparty", "medium", r"\b(?:PAYPAL|VENMO|PayPal|Venmo)[ \t]+\*[ \t]?([A-Z][A-Za-z'’-]{3,}(?:[ \t][A-Z][\w'’-]+)?)"),
    ("counterparty", "high", rf"\b(?:Website|User|Refund)?[ \t]?Payment(?: Refund)?[ \t]*[-:][ \t]*({_NAME}?)[ \t]+(?:ID|USD)\b"),
    ("counterparty", "high", rf"TYPE:[ \t]*P2P[ \t]+CO:[ \t]*({_NAME})"),
    ("counterparty", "high", rf"\bPay Friends to[ \t]+({_NAME})"),
)
#: What stands before an employer in the descriptions of deposits, and after one.
EMPLOYERS = (
    ("employer", "high", r"\b(?:Employer(?:\(s\)|['’]s name| name)?|Name of employer):?[ \t]+([A-Z][\w&.,'’ -]{2,60}?)(?=[ \t]{2,}|[ \t]*\n|[ \t]*$)"),
    ("employer", "medium", r"\b(?:DIRECT DEP(?:OSIT)?|ACH DEPOSIT|Deposit ACH|Ach Credit)[ \t]+([A-Z][\w&.'’ ]{2,40}?)[ \t]+(?:PAYROLL|Payroll|TYPE: PAYROLL|Dir Dep|DIR DEP)\b"),
    ("employer", "medium", r"^(?:\d{1,2}/\d{1,2}(?:/\d{2,4})?[ \t]+)?([A-Z][\w&.'’ ]{2,40}?)[ \t]+(?:DES:[ \t]*PAYROLL|Payroll(?:[ \t]+PPD)?[ \t]+(?:ID|\d{6}))"),
    ("employer", "medium", r"\b[Dd]irect [Dd]eposit(?: from|[ \t]*-)[ \t]+([A-Z][\w&.'’ ]{2,40}?)(?=[ \t]+[+$]|[ \t]*\n|[ \t]*$)"),
    ("employer", "medium", r"\bPAYROLL CONTRIBUTION[ \t]+([A-Z][A-Z&.'’ ]{2,40}?)(?=[ \t]+\$|[ \t]*\n|[ \t]*$)"),
    ("employer", "medium", r"^[ \t]*([A-Z][A-Z&.'’ ]{4,50}?)[ \t]+401\(K\)[ \t]+(?:SAVINGS|RETIREMENT)?[ \t]*PLAN\b"),
)
HOLDERS = (
    ("cardholder", "high", rf"\b(?:Cardholder|Account holder|Card member):?[ \t]+({_NAME})"),
    ("cardholder", "medium", rf"({_NAME})[ \t]+Card Ending\b"),
    ("holder", "high", rf"\b(?:Statement|Account(?: summary)?|Prepared) for:?[ \t]+({_NAME})"),
)
LABELLED = (
    ("person", "high", rf"\b(?:Borrower|Co-Borrower|Patient(?: name)?|Insured|Taxpayer|Spouse|Beneficiary|Employee(?: name)?|Buyer|Seller|Tenant|Member name):[ \t]+({_NAME})"),
    ("receiver", "high", rf"\bINDN:[ \t]*({_UPPER_NAME}?)[ \t]+(?:CO ID|ID|PPD)\b"),
    ("receiver", "medium", rf"\b[Pp]ayroll[ \t]+\d{{6}}[ \t]+\d{{6,}}[ \t]+({_NAME})"),
)
_SETS = (CAPTIONS, OFFICIALS, CHILDREN, PLACES, PAYMENTS, EMPLOYERS, HOLDERS, LABELLED)
#: For each pattern what a text must hold to match it, for a linear-time automaton over whole Arrow batches. There
#: \s and \d are those of ASCII, so any other character counts as either; parts that ignore case have no letter
#: that Python folds otherwise (i, k and s).
_HINTS = (
    # captions
    _ROLE, _ROLE, "IN THE MATTER OF THE", "IN THE MATTER OF THE", r"formerly known as|[fa]/k/a|also known as|n[eé]e[ \t]",
    # officials
    "Judge|Justice|Officer|Commissioner|Magistrate|Referee|Hon", "Judge|Commissioner", "(?:COURT|Court) (?:JUDGE|Judge|COMMISSIONER|Commissioner)", "(?i)the court|comm", "Clerk of",
    # children
    r"(?:[Bb]orn|DOB|d\.o\.b\.)[: \t]", "minor child", "custody of",
    # places
    "resid|liv", "(?:moved|relocated|returned) to", "(?:located|married|born|employed) (?:in|at)", rf"{_STATE}\.?[ \t]+(?:[0-9]|[^\x00-\x7F])", rf",[ \t]+{_STATE}",
    # payments
    rf"{_RAIL}(?:[ \t]+(?:payment|PAYMENT|PMT))?[ \t]+(?:to|from|TO|FROM)[ \t]", "ZELLE|Zelle", r"(?:CHECK|Check)[ \t]", r"(?:ACH|ach)[ \t]+(?:PMT|PAYMENT|Payment|pmt)", r"(?:PAYPAL|VENMO|PayPal|Venmo)[ \t]+\*", r"Payment(?: Refund)?[ \t]*[-:]", r"TYPE:[ \t]*P2P", "Pay Friends to",
    # employers
    "[Ee]mployer", "DIRECT DEP|ACH DEPOSIT|Deposit ACH|Ach Credit", r"DES:[ \t]*PAYROLL|Payroll", "[Dd]irect [Dd]eposit", "PAYROLL CONTRIBUTION", r"401\(K\)",
    # holders
    "Cardholder|Account holder|Card member", "Card Ending", "(?:Statement|Account(?: summary)?|Prepared) for",
    # labelled
    r"(?:Borrower|Patient(?: name)?|Insured|Taxpayer|Spouse|Beneficiary|Employee(?: name)?|Buyer|Seller|Tenant|Member name):[ \t]", "INDN:", r"[Pp]ayroll[ \t]",
)
_SIGNED = re.compile(r"^(?P<name>.*?\S)[ \t]{2,}(?P<sum>[-+][ \t]?\$?[\d,]+\.\d{2})\s*$")
_STREET = re.compile(rf"^[ \t]*\d+[A-Za-z]?[ \t]+\S+.*$|^[ \t]*P\.?O\.? Box \d+", re.IGNORECASE)
_STUB = re.compile(r"\b(?:pay stub|pay statement|earnings statement)\b", re.IGNORECASE)
_GAP = re.compile(r"\s+")
_AVATAR = re.compile(r"^[A-Z][ \t]{2,}(?=[A-Z])")


_BLANK = r"[\s\x0B\x1C-\x1F]"
#: The same for a line that may begin an address below another line.
_BELOW = rf"\n{_BLANK}*(?:[0-9]+[A-Za-z]?{_BLANK}|[0-9A-Za-z]*[^\x00-\x7F])|(?i:box)"


def _compiled(cache: list = []) -> list:  # noqa: B006  compiled once a process
    if not cache:
        cache += [(k, c, re.compile(p, re.MULTILINE)) for group in _SETS for k, c, p in group]
    return cache


def _fits(kind: str, value: str) -> bool:
    w = words(value)
    if kind in ("party", "former", "official", "child"):
        return plausible(value.split(), BOILERPLATE) and not set(w) & RAILS
    if kind == "employer":
        return bool(w) and not is_address(value) and not set(w) & {"address", "checking", "savings", "your", "the"} and w[0] not in FORM_WORDS
    if kind in _PERSONS:
        return acceptable_person(value)
    return kind != "place" or not set(w) & {"act", "county", "parish", "court"}


def propose(text: str, needed: Sequence[int] | None = None) -> list[Proposal]:
    """All proposals of one text, each place of a kind once, with its best confidence. ``needed``: the numbers of
    the patterns and readings that the text may match, by default all."""
    out: dict[tuple[str, int], Proposal] = {}
    patterns = _compiled()
    for i in range(len(patterns) + len(READINGS)) if needed is None else needed:
        if i >= len(patterns):
            for p in READINGS[i - len(patterns)][0](text):
                _keep(out, p)
            continue
        kind, confidence, pattern = patterns[i]
        for m in pattern.finditer(text):
            if value := _value(kind, m[1]):
                _keep(out, (kind, value, confidence, m.start(1)))
    paid = {v.lower() for k, v, _, _ in out.values() if k == "counterparty"}
    return sorted((p for p in out.values() if p[0] != "employer" or p[1].lower() not in paid), key=lambda p: (p[3], p[0]))


@lru_cache(maxsize=4096)  # names recur
def _value(kind: str, captured: str) -> str | None:
    """The value as it is proposed, if its kind allows it."""
    value = _GAP.sub(" ", captured).strip(" .,:;-")
    if kind in ("counterparty", "holder", "cardholder", "person"):
        value = without_tail(value)
    return value if value and _fits(kind, value) else None


def needed_by(texts: pa.Array) -> list[list[int]]:
    """For each text the numbers of the patterns and readings whose hints it holds."""
    found = [pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in (*_HINTS, *[h for _, h in READINGS])]
    out: list[list[int]] = [[] for _ in range(len(texts))]
    for row, i in zip(*(x.tolist() for x in np.nonzero(np.stack(found, axis=1))), strict=True):
        out[row].append(i)
    return out


def _keep(out: dict[tuple[str, int], Proposal], p: Proposal) -> None:
    was = out.get((p[0], p[3]))
    if was is None or _RANK[p[2]] > _RANK[was[2]]:
        out[p[0], p[3]] = p


def _lines(text: str) -> list[tuple[int, str]]:
    at, out = 0, []
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


def account_holders(text: str) -> list[Proposal]:
    """Up to three lines of names right above a street; "A and B Morgan" are two people of one last name."""
    out, rows = [], _lines(text)
    for i, (_, line) in enumerate(rows):
        if not is_address(line) or not _STREET.match(line):
            continue
        for at, above in reversed(rows[max(0, i - 3) : i]):
            names = re.split(r"\s+(?:and|AND|&)\s+", above.strip())
            last = names[-1].split()[-1] if names[-1].split() else ""
            names = [n if len(n.split()) > 1 else f"{n} {last}" for n in names]
            if not above.strip() or not all(acceptable_person(n) and n[:1].isupper() and len(n.split()) > 1 for n in names):
                break
            begin = at + len(above) - len(above.lstrip())
            out += [("holder", n, "medium", begin + j) for j, n in enumerate(names)]  # one place for each of a line's names
    return out


def activity_feed(text: str) -> list[Proposal]:
    """Names before signed sums, where a text has at least two such lines."""
    rows = [(at, m) for at, line in _lines(text) if (m := _SIGNED.match(line))]
    out = []
    for at, m in rows if len(rows) >= 2 else ():
        skip = a.end() if (a := _AVATAR.match(m["name"])) else 0
        name = m["name"][skip:]
        if acceptable_person(name) and len(name.split()) > 1 and not is_business(name):
            out.append(("feed", name, "medium", at + skip))
    return out


def ledger_parties(text: str) -> list[Proposal]:
    """Both ends of the rows below a head with From and To: the cells of a row that are people, if two are."""
    out, below = [], False
    for at, line in _lines(text):
        if re.search(r"\bFrom\b.*\bTo\b", line):
            below = True
            continue
        cells = [(m.start(), m[0]) for m in re.finditer(r"\S+(?: \S+)*", line)] if below else []
        people = [(a, c) for a, c in cells if len(c.split()) > 1 and acceptable_person(c)]
        if len(people) == 2:
            out += [("feed", c, "medium", at + a) for a, c in people]
    return out


def direction_rows(text: str) -> list[Proposal]:
    """Names after "Sent" or "Received" in rows with a sum."""
    out = []
    for at, line in _lines(text):
        if (m := re.search(rf"\b(?:Sent|Received)[ \t]{{2,}}({_NAME})(?=[ \t]{{2,}})", line)) and re.search(r"\$[\d,]+\.\d{2}", line) and acceptable_person(m[1]):
            out.append(("feed", m[1], "medium", at + m.start(1)))
    return out


def own_businesses(text: str) -> list[Proposal]:
    """Businesses above a street or a report's head, or the receiver of a transfer; no institution. What a pay
    stub bears is an employer's."""
    out, rows = [], [] if _STUB.search(text) else _lines(text)
    for i, (at, line) in enumerate(rows):
        name = line.strip()
        near = [x for _, x in rows[i + 1 : i + 3]]
        if is_business(name) and not set(words(name)) & INSTITUTIONS and any(is_address(x) or re.match(r"\s*(?:Profit and Loss|Balance Sheet)\b", x) for x in near):
            out.append(("business", name, "medium", at + len(line) - len(line.lstrip())))
    for m in re.finditer(rf"\bINDN:[ \t]*({_UPPER_NAME}?)[ \t]+(?:CO ID|ID|PPD)\b", text):
        if is_business(m[1]):
            out.append(("business", m[1], "medium", m.start(1)))
    return out


def pay_stub_employers(text: str) -> list[Proposal]:
    """The letterhead of a pay stub: a line right above a street or the stub's title that is no person."""
    if not _STUB.search(text) or not re.search(r"\bnet pay\b", text, re.IGNORECASE):
        return []
    out, rows = [], _lines(text)
    for i, (at, line) in enumerate(rows[:-1]):
        name, below = line.strip(), rows[i + 1][1]
        if name and not _STUB.search(name) and (is_address(below) or _STUB.search(below)) and not is_address(name) and not set(words(name)) & (INSTITUTIONS | FORM_WORDS):
            if is_business(name) or len(words(name)) >= 3 and not re.search(r"\b[A-Z]\.?\s", name):
                out.append(("employer", name, "medium", at + len(line) - len(line.lstrip())))
    return out


#: The readings of whole texts, and what a text must hold for each.
READINGS = (
    (account_holders, _BELOW), (activity_feed, r"[ \t]{2}[-+]"), (own_businesses, rf"{_BELOW}|Profit and Loss|Balance Sheet|INDN:"), (pay_stub_employers, "(?i)net pay"),
    (ledger_parties, r"From[^\n]*To[^\n]*\n"), (direction_rows, r"(?:Sent|Received)[ \t]{2}"),
)


def harvest(units: DataFrame, classifier: Callable[[list[str]], list[bool]] | None = None) -> DataFrame:
    """doc_id, kind, value, confidence and begin of all proposals; ``classifier`` may say of each value
    whether it is a name, and then those that are none go. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            rows = [(d, *p) for d, t, n in zip(batch.column("doc_id").to_pylist(), texts.to_pylist(), needed_by(texts), strict=True) if n for p in propose(t, n)]
            if classifier and rows:
                rows = [r for r, keep in zip(rows, classifier([r[2] for r in rows]), strict=True) if keep]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()), strict=True)], ["doc_id", "kind", "value", "confidence", "begin"])

    return units.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, value string, confidence string, begin int")


def confirmed_places(proposals: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The places among proposals that a gazetteer (name) knows, in its spelling: the longest known beginning
    of what was captured, as context tells where a town's name begins but not where it ends."""
    size = F.size(F.split("value", " "))
    rows = proposals.where("kind = 'place'").withColumn("__n", F.explode(F.sequence(F.lit(1), size)))
    rows = rows.withColumn("__part", F.lower(F.array_join(F.slice(F.split("value", " "), 1, F.col("__n")), " ")))
    known = gazetteer.groupBy(F.lower("name").alias("__part")).agg(F.min("name").alias("place"))
    hit = rows.join(known, "__part")
    return hit.groupBy("doc_id", "begin").agg(F.max_by("place", "__n").alias("place"))


def best_evidence(proposals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row for each kind and value: its best confidence, documents and finds. Values in ``known``
    (column value) go; so do one-word names that a fuller one of the kind holds."""
    rank = F.create_map(*[F.lit(x) for p in _RANK.items() for x in p])
    out = proposals.groupBy("kind", F.lower("value").alias("folded")).agg(F.min_by("value", F.struct("doc_id", "begin")).alias("value"), F.max_by("confidence", rank[F.col("confidence")]).alias("confidence"), F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("finds"))
    if known is not None:
        out = out.join(known.select(F.lower("value").alias("folded")).distinct(), "folded", "left_anti")
    fuller = out.where(F.size(F.split("folded", " ")) > 1).select("kind", F.explode(F.split("folded", " ")).alias("folded")).distinct()
    return out.join(fuller, ["kind", "folded"], "left_anti").drop("folded")


def collect(proposals: DataFrame, known: DataFrame, financial: DataFrame) -> DataFrame:
    """What a review is shown: the best evidence of each value that is not known by itself or by its words;
    organisations that stand in financial documents only are left out. ``financial``: doc_id."""
    names = known.select(F.lower("value").alias("value")).distinct()
    parts = names.select(F.explode(F.split("value", r"\s+")).alias("value"))
    best = best_evidence(proposals, names.unionByName(parts).distinct())
    flag = financial.select("doc_id").distinct().withColumn("__fin", F.lit(1))
    seen = proposals.join(flag, "doc_id", "left").groupBy("kind", F.lower("value").alias("__v")).agg(F.bool_and(F.col("__fin").isNotNull()).alias("__only"))
    out = best.withColumn("__v", F.lower("value")).join(seen, ["kind", "__v"])
    return out.where(~(F.col("kind").isin("business", "organization") & F.col("__only"))).drop("__v", "__only")
