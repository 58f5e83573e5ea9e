"""Invented names for real ones: the same for the same person, never a real or used one."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.names import _key, parse

#: Invented names are put together from these parts, so that lists stay short.
_HEADS = "Al Ber Cor Dan El Fen Gar Hol Ig Jor Kel Lan Mar Nor Os Per Quin Ros Sel Tor Ul Ver Wil Yor".split()
_GIVEN_ENDS, _LAST_ENDS = "an a en ina o eth is ette".split(), "mont ley wick ford stad berg ham dale worth by".split()
GIVEN = [h + e for h in _HEADS for e in _GIVEN_ENDS]
LAST = [h + e for h in _HEADS for e in _LAST_ENDS]
#: Draws of a single part.
ATTEMPTS = 64


def pick(salt: bytes, n: int, *parts: str) -> int:
    return int.from_bytes(hmac.new(salt, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:8], "big") % n


def _draws(pool: list[str], salt: bytes, *parts: str) -> Iterator[str]:
    """Parts of the pool as the keyed hash picks them; after ATTEMPTS of them two parts with a hyphen, then
    three and so on, so that there is always one that is not used."""
    for k in count():
        yield "-".join(pool[pick(salt, len(pool), *parts, str(k), *([str(j)] if j else []))] for j in range(1 + k // ATTEMPTS))


def assign(names: list[str], salt: bytes) -> dict[str, str]:
    """A full invented name for each real one, in the order given. Equal last names share an invented
    one; no invented part is a real part, and no two people get the same name."""
    parsed = {n: parse(n) for n in names}
    real = {_key(w) for p in parsed.values() for w in (p.first, *p.middles, *p.last.split())}
    last_of: dict[str, str] = {}
    out: dict[str, str] = {}
    for name, p in parsed.items():
        family = _key(p.last)
        if family and family not in last_of:
            last_of[family] = next(made for made in _draws(LAST, salt, "last", family) if _key(made) not in real and made not in last_of.values())
        used = set(out.values())
        for first in _draws(GIVEN, salt, "first", _key(p.first), family):
            made = " ".join(x for x in (first, last_of.get(family, "")) if x)
            if not {_key(w) for w in first.split("-")} & real and made not in used:
                break
        out[name] = made
    return out


def surrogates(people: DataFrame, salt: bytes) -> DataFrame:
    """set_id, name and replacement. A set is the people of one case: some tens of names, so each set is
    one group; sets are many and independent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = assign(sorted(set(pdf["name"].dropna())), salt)
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "name": list(made), "replacement": list(made.values())})

    return people.select("set_id", "name").groupBy("set_id").applyInPandas(run, "set_id string, name string, replacement string")


def match_all(texts: Iterator[str], made: dict[str, str]) -> Iterator[str]:
    """Texts with every full name replaced, the longest first."""
    order = sorted(made, key=len, reverse=True)
    for t in texts:
        for name in order:
            t = t.replace(name, made[name])
        yield t
