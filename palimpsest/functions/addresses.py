"""Reading of street addresses."""

from __future__ import annotations

import re
from dataclasses import astuple, dataclass, fields

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short and long forms of directions and street suffixes.
DIRECTIONS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "nw": "nw", "se": "se", "sw": "sw"}
SUFFIXES = {"street": "st", "st": "st", "avenue": "ave", "ave": "ave", "road": "rd", "rd": "rd", "boulevard": "blvd", "blvd": "blvd", "lane": "ln", "ln": "ln", "drive": "dr", "dr": "dr", "court": "ct", "ct": "ct", "circle": "cir", "cir": "cir", "way": "way", "place": "pl", "pl": "pl", "terrace": "ter", "ter": "ter", "parkway": "pkwy", "pkwy": "pkwy", "highway": "hwy", "hwy": "hwy", "trail": "trl", "trl": "trl"}
_UNIT = re.compile(r"\b(?:apt|apartment|unit|suite|ste|#)\.?\s*([\w-]+)", re.IGNORECASE)
_BOX = re.compile(r"\b(?:p\.?\s?o\.?\s+box|post\s+office\s+box)\s+(\d+)", re.IGNORECASE)
_ZIP = re.compile(r"\b(\d{5})(?:-\d{4})?\s*$")
_GLUED = re.compile(r"^(\d+)([A-Za-z]{3,})")


@dataclass(frozen=True)
class Address:
    number: str = ""
    direction: str = ""
    street: str = ""
    suffix: str = ""
    unit: str = ""
    city: str = ""
    zip5: str = ""
    box: str = ""


def parse_address(text: str | None) -> Address:
    """House number, direction, street words, suffix, unit, city, ZIP and post-office box; a number
    glued to its street is parted."""
    text = _GLUED.sub(r"\1 \2", " ".join((text or "").split()))
    zip5 = (m := _ZIP.search(text)) and m[1] or ""
    box = (m := _BOX.search(text)) and m[1] or ""
    unit = (m := _UNIT.search(text)) and m[1] or ""
    rest = _ZIP.sub("", _BOX.sub("", _UNIT.sub("", text)))
    parts = [p.strip() for p in rest.split(",") if p.strip()]
    words = re.sub(r"[.]", "", parts[0]).split() if parts else []
    number = words.pop(0) if words and words[0][0].isdigit() else ""
    direction = suffix = city = ""
    if len(words) > 1 and words[0].lower() in DIRECTIONS:
        direction = DIRECTIONS[words.pop(0).lower()]
    for i in range(len(words) - 1, 0, -1):
        if words[i].lower() in SUFFIXES:
            suffix, tail, words = SUFFIXES[words[i].lower()], words[i + 1 :], words[:i]
            city = " ".join(w for w in tail if not re.fullmatch(r"[A-Z]{2}", w))
            break
    if not city and len(parts) > 1:
        city = re.sub(r"\s+[A-Z]{2}$", "", parts[1]).strip()
        city = "" if re.fullmatch(r"[A-Z]{2}", city) else city
    return Address(number, direction, " ".join(words).lower(), suffix, unit.lower(), city.lower(), zip5, box)


_TYPE = T.StructType([T.StructField(f.name, T.StringType()) for f in fields(Address)])


@F.pandas_udf(_TYPE)
def address_parts(value: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([astuple(parse_address(v)) for v in value], columns=[f.name for f in fields(Address)])


def same_place(a: Address, b: Address) -> bool:
    """House, street and unit agree, and neither direction, town nor ZIP contradicts."""
    fine = lambda x, y: not x or not y or x == y
    if a.box or b.box:
        return a.box == b.box and fine(a.zip5, b.zip5)
    return a.number == b.number and a.street == b.street and a.unit == b.unit and fine(a.direction, b.direction) and fine(a.city, b.city) and fine(a.zip5, b.zip5)
