"""Personal data with offset-preserving deobfuscation.

Identifiers are found in the text as it is. Texts that hold disguises are then rewritten by
transducers: look-alike letters, digits and signs become plain ones, letters among digits too; spelled
digits become digits, alone or among plain ones; "at" and "dot" in brackets, between names, joined to
them or between numbers and "plus" before a number become signs; signs lose the spaces around them.
Each keeps for every character where its source begins and ends, so what is found in the rewritten
text maps back to the source. Whether digits are an identifier is left to its own length and check
digit.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, text_slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, as the one before it took its run whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """What the pattern finds from left to right: a local part is the whole run before its sign."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def find_base(text: str) -> dict[str, list[Span]]:
    """Spans of the four kinds in a text as it is."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def _lookalikes() -> dict[str, str]:
    """Full-width forms and digits of other scripts by rule; letters of other alphabets that look
    like Latin ones; dashes, stops and signs; marks without width go."""
    table = {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}
    for c in range(0x660, 0x1E960):
        ch = chr(c)
        if unicodedata.category(ch) == "Nd":
            table.setdefault(ch, str(unicodedata.digit(ch)))
    table |= dict(zip("аеорсухіјѕԁһԛԝвкмтАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhqwvkmtABEKMHOPCTXIJS", strict=True))
    table |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp", strict=True))
    table |= dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("․。｡", ".") | {"﹫": "@"}
    table |= dict.fromkeys(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)), " ")
    return table | dict.fromkeys(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)), "")


LOOKALIKES = _lookalikes()
_LOOKALIKE = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
#: The digits in the languages of the corpus, 0 to 9.
_SPELLED = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_NEAR = r"[\s,.-]{1,3}"
_SPELLED_RUN = re.compile(rf"(?<![\w@]){_NUMBER}(?:{_NEAR}{_NUMBER})*(?![\w@])", re.IGNORECASE)
#: Spelled and plain digits in any mixture, with their sign.
_MIXED = re.compile(rf"(?<![\w@])(?P<sign>plus[\s,.(-]{{1,3}}|\+[\s,.(-]{{0,3}})?(?:{_NUMBER}|[0-9]+)(?:[\s,.()-]{{1,4}}(?:{_NUMBER}|[0-9]+))*(?![\w@])", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+")
_PLUS = re.compile(r"(?<![\w@])(?<![0-9]\s)plus[\s,.-]{1,3}(?=\(?[0-9])", re.IGNORECASE)
#: Letters that are read for digits.
_MISTAKEN = {"O": "0", "o": "0", "l": "1", "I": "1"}
_MISTAKEN_TO = str.maketrans(_MISTAKEN)
#: Letters that the patterns take for i, s and k when they ignore case.
_FOLD = str.maketrans("İıſK", "iisk")
_AT = r"(?:at|arroba|ät)"
_DOT = r"(?:dot|punkt|point|punto)"
_BRACKETED_AT = re.compile(rf"\s*[\[({{<]\s*(?:{_AT}|@)\s*[\])}}>]\s*", re.IGNORECASE)
_BRACKETED_DOT = re.compile(rf"\s*[\[({{<]\s*(?:{_DOT}|\.)\s*[\])}}>]\s*", re.IGNORECASE)
#: Bare words count only together: name at name dot name.
_BARE = re.compile(rf"(?<![\w@])[\w.+-]+(?P<at>\s+{_AT}\s+|@)[\w-]+(?:\s+{_DOT}\s+[\w-]+)+(?!\w)", re.IGNORECASE)
#: A name at a written-out host; names joined to their signs by hyphens or underscores; spaced signs.
_AT_HOST = re.compile(rf"(?<![\w@.-])(?P<name>[\w.+-]*\w)(?P<at>\s+{_AT}\s+)[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{{2,24}}(?![\w@])", re.IGNORECASE)
_JOINED = re.compile(rf"(?<![\w@.-])[A-Z0-9.+]+(?P<at>[_-]{_AT}[_-])[A-Z0-9]+(?:[_.-][A-Z0-9]+)*?(?:[_-]{_DOT}[_-][A-Z0-9]+)+(?![\w@-])", re.IGNORECASE)
_JOINED_DOT = re.compile(rf"[_-]{_DOT}[_-]", re.IGNORECASE)
_SPACED_AT = re.compile(r"(?<=[\w])\s{1,3}@\s{1,3}(?=[\w-]+\.[^\W\d_]{2})|(?<=\w)[\[({]a[\])}](?=\w)", re.IGNORECASE)
_SPACED_STOP = re.compile(r"(?<=[0-9])\s\.\s(?=[0-9])")
#: Digits and letters that look like some, with what may stand between; fours with other signs between.
_MISREAD = re.compile(r"(?<![\w+])\+?[0-9OolI](?:[ .()-]{0,2}[0-9OolI]){6,}(?![\w])")
_ODD_FOURS = re.compile(r"(?<![\w.])[0-9]{4}(?P<sign>[._/·])[0-9]{4}(?P=sign)[0-9]{4}(?P=sign)[0-9]{1,7}(?![\w.])")
#: Words before "at" and a host that make prose: "available at example.com".
_NO_NAME = frozenset(
    "all and are available be been blog buy chat code come contact details directly docs documentation download everyone find found get go here him her hosted info information is it join live look me meet more "
    "now online or order out page people please posted published read register registered see shop sign site sold start store stuff team that them there this today try up us visit was website were work working works you".split()
)
_BARE_DOT = re.compile(rf"\s+{_DOT}\s+", re.IGNORECASE)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])\s*(?<![^\W\d_]){_DOT}\s*(?=[0-9])", re.IGNORECASE)
_END = re.compile(r"[^\W\d_]{2,}|xn--[\w-]+", re.IGNORECASE)
#: Words that make "at the dot of" and "at this point in" prose, and ends of host names
#: that are read as such even there.
_PROSE = frozenset("the a an this that these those some any one no every each which what his her its my your our their der die das dem den ein einem einer le la les un une el los las".split())
_HOST_ENDS = frozenset("com org net edu gov io info biz eu de fr es uk us ca ch it nl be example test invalid local".split())
#: What every disguise holds, as one automaton over whole batches: four spelled digits in a row, one
#: beside a plain digit, "plus" before a digit, a sign in brackets, a lone "dot", or a look-alike.
HINT = "(?i:" + "|".join(
    [_NEAR.join([_NUMBER] * 4), rf"[0-9][\s,.()-]{{1,4}}{_NUMBER}\b", rf"\b{_NUMBER}[\s,.()-]{{1,4}}[0-9]", r"\bplus[\s,.-]{1,3}\(?[0-9]",
     rf"[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.)\s*[\])}}>]", rf"\s{_DOT}\s", rf"[0-9]\s*{_DOT}\s*[0-9]", rf"[_-]{_DOT}[_-]", rf"\s{_AT}\s+[\w-]+\.\w\w", r"\s@\s", r"\w[\[({]a[\])}]\w",
     r"[0-9]\s\.\s[0-9]", r"[0-9][ .()-]{0,2}[ol][0-9 .()-]", r"[ol][ .()-]{0,2}[0-9]{2}", r"[0-9 .-]i[0-9]", r"[0-9]{4}[._/·][0-9]{4}[._/·][0-9]{4}"]
) + ")|[" + "".join(f"\\x{{{ord(c):x}}}" for c in LOOKALIKES) + "]"


@dataclass
class Mapped:
    """A rewritten text; character i stands for ``source[begin[i]:end[i]]``."""

    text: str
    begin: np.ndarray
    end: np.ndarray
    changed: np.ndarray

    @classmethod
    def plain(cls, text: str) -> Mapped:
        n = np.arange(len(text))
        return cls(text, n, n + 1, np.zeros(len(text), bool))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans, which are in order and apart; the new characters stand for the whole span."""
        if not edits:
            return self
        text, begin, end, changed, last = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[last:a], new]
            begin.append(self.begin[last:a])
            end.append(self.end[last:a])
            changed.append(self.changed[last:a])
            if new:
                begin.append(np.full(len(new), self.begin[a]))
                end.append(np.full(len(new), self.end[b - 1]))
                changed.append(np.ones(len(new), bool))
            last = b
        return Mapped("".join(text), np.concatenate(begin), np.concatenate(end), np.concatenate(changed))

    def source(self, a: int, b: int) -> Span:
        return int(self.begin[a]), int(self.end[b - 1])


def _digit(word: str) -> str:
    return _SPELLED.get(word.translate(_FOLD).lower(), word)


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    """A run that is a phone or a card as a whole becomes its digits; in any other, spelled digits do
    and what stands between them and plain ones stays."""
    out = []
    for m in _MIXED.finditer(text):
        begin = m.end("sign") if m["sign"] else m.start()
        tokens = [(t.start(), t.end(), _digit(t[0])) for t in _TOKEN.finditer(text, begin, m.end())]
        spelled = [not text[a].isdigit() for a, _, _ in tokens]
        if not any(spelled):
            continue
        if m["sign"] and 9 <= sum(len(d) for _, _, d in tokens) <= 15:
            out.append((*m.span(), "+" + "".join(d for _, _, d in tokens)))
            continue
        n = len(tokens)
        for i, j in ((0, n), (0, n - 1), (1, n)):  # a number word of the prose may stand at an end
            digits = "".join(d for _, _, d in tokens[i:j])
            if any(spelled[i:j]) and all(spelled[:i] + spelled[j:]) and 13 <= len(digits) <= 19 and luhn(digits):
                out.append((tokens[i][0], tokens[j - 1][1], digits))
                break
        else:
            for r in _SPELLED_RUN.finditer(text, begin, m.end()):
                out.append((*r.span(), "".join(_digit(t) for t in _TOKEN.findall(r[0]))))
    return out


def _misread_edits(text: str) -> list[tuple[int, int, str]]:
    """Letters among digits become digits where the run as a whole is then an address, a card or a phone."""
    out = []
    for m in _MISREAD.finditer(text):
        run = m[0]
        letters = [i for i, c in enumerate(run) if c in _MISTAKEN]
        if not letters or 3 * len(letters) >= 2 * sum(c.isdigit() for c in run):
            continue
        found = find_base(run.translate(_MISTAKEN_TO))
        if any((0, len(run)) in spans for spans in found.values()):
            out += [(m.start() + i, m.start() + i + 1, _MISTAKEN[run[i]]) for i in letters]
    return out


def _four_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs between the fours of a card that has right check digits become hyphens."""
    out = []
    for m in _ODD_FOURS.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out += [(m.start() + i, m.start() + i + 1, "-") for i in (4, 9, 14)]
    return out


def _at_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs of names that stand before a written-out host, or are joined to their signs."""
    out = []
    for m in _AT_HOST.finditer(text):
        name = m["name"].lower()
        if name not in _NO_NAME and name not in _PROSE:
            out.append((*m.span("at"), "@"))
    for m in _JOINED.finditer(text):
        out.append((*m.span("at"), "@"))
        out += [(*d.span(), ".") for d in _JOINED_DOT.finditer(text, m.end("at"), m.end())]
    out += [(*m.span(), "@") for m in _SPACED_AT.finditer(text)] + [(*m.span(), ".") for m in _SPACED_STOP.finditer(text)]
    apart, last = [], 0
    for a, b, new in sorted(out):
        if a >= last:
            apart.append((a, b, new))
            last = b
    return apart


def _plus_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _PLUS.finditer(text):
        phone = _PHONE.match("+" + text[m.end() : m.end() + 64].lstrip("("))
        if phone and 9 <= sum(c.isdigit() for c in phone[0]) <= 15:
            out.append((m.start(), m.end() + (text[m.end()] == "("), "+"))
    return out


def _is_host(m: re.Match) -> bool:
    """Whether name-at-host-dot-end is an address: "at breaking point when" and "at the dot of" are prose
    unless a common end follows."""
    words = m[0][m.end("at") - m.start() :].split()
    if words[-1].lower() in _HOST_ENDS:
        return True
    prose = words[0].lower() in _PROSE or (m["at"].strip().lower() == "at" and words[-2].lower() == "point")
    return bool(_END.fullmatch(words[-1])) and not prose


def deobfuscate(text: str) -> Mapped:
    """The text without its disguises."""
    plain = Mapped.plain(text)
    if not text.isascii():
        plain = plain.rewrite([(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _LOOKALIKE.finditer(text)])
    plain = plain.rewrite(_misread_edits(plain.text))
    plain = plain.rewrite(_four_edits(plain.text))
    plain = plain.rewrite(_spelled_edits(plain.text))
    plain = plain.rewrite([(*m.span(), "@") for m in _BRACKETED_AT.finditer(plain.text)])
    plain = plain.rewrite([(*m.span(), ".") for m in _BRACKETED_DOT.finditer(plain.text)])
    edits = []
    for m in _BARE.finditer(plain.text):
        at, after = m.span("at"), m.end("at")
        if _is_host(m):
            edits += [(*at, "@")] if plain.text[slice(*at)] != "@" else []
            edits += [(*d.span(), ".") for d in _BARE_DOT.finditer(plain.text, after, m.end())]
    plain = plain.rewrite(edits)
    plain = plain.rewrite(_at_edits(plain.text))
    plain = plain.rewrite([(*m.span(), ".") for m in _NUMBER_DOT.finditer(plain.text)])
    return plain.rewrite(_plus_edits(plain.text))


def _only_a_word(text: str, wide: Span, narrow: Span) -> bool:
    """Whether a span has only one spelled digit more than one it holds: "+1 801 555 0100, one of"."""
    words = _TOKEN.findall(text[wide[0] : narrow[0]]) + _TOKEN.findall(text[narrow[1] : wide[1]])
    return len(words) == 1 and words[0].isalpha() and _digit(words[0]) != words[0]


def hinted(texts: pa.Array) -> list[bool]:
    """Which texts may hold a disguise; those that aren't need no rewriting."""
    return pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()


def find(text: str, hint: bool = True) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(spans in the text as it is, spans that only its rewritten form shows), in source offsets.
    A disguised span that touches plain ones of its kind is left out, unless it holds them whole."""
    base = find_base(text)
    more = {k: [] for k in KINDS}
    if not hint:
        return base, more
    plain = deobfuscate(text)
    for kind, spans in find_base(plain.text).items():
        for a, b in spans:
            s = plain.source(a, b)
            if s[1] - s[0] == b - a and not plain.changed[a:b].any():
                continue
            if all(s[1] <= x or y <= s[0] or (s[0] <= x and y <= s[1] and s != (x, y) and not _only_a_word(text, s, (x, y))) for x, y in base[kind]):
                more[kind].append(s)
    return base, more


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def redact(text: str | None, hint: bool = True) -> str | None:
    """The text with a label in place of every span; where spans overlap, of the first and longest."""
    if not text:
        return text
    base, more = find(text, hint)
    out, last = [], 0
    for a, b, kind in sorted(((a, -b, k) for x in (base, more) for k, spans in x.items() for a, b in spans)):
        b = -b
        if b <= last:
            continue
        if a < last:  # the rest of a span that begins inside another goes with it
            last = b
            continue
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]]) if out else text


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long"


def find_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of plain spans by kind, their digest, all spans as text, and counts of disguised and of all
    spans, for every row.

    Offsets are code points, ends exclusive. Null and empty texts hold none; repeated rows each
    get theirs; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = []
            for doc, text, hint in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), hinted(batch.column("text")), strict=True):
                base, more = find(text or "", hint)
                both = {k: base[k] + more[k] for k in KINDS}
                rows.append((doc, *(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), sum(map(len, more.values())), sum(map(len, both.values()))))
            names = [c.split()[0] for c in RESULT.split(", ")]
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(giving_back(run), RESULT)


def redact_documents(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their spans replaced in the text; every other column stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            new = pa.array([redact(t, h) for t, h in zip(batch.column(at).to_pylist(), hinted(batch.column(at)), strict=True)], batch.schema.field(at).type)
            yield batch.set_column(at, text_col, new)

    return documents.mapInArrow(giving_back(run), documents.schema)
