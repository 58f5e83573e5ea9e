"""Lines built alike in Spark and in DuckDB's SQL, whose findings are known without a pattern.

A line is a list of segments: plain text, digits taken from a row's key, or a finding, which is a
category and its own segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Digits:
    """``(key * times) % modulo + plus``, with zeros in front up to ``width`` digits."""

    width: int
    modulo: int = 0
    plus: int = 0
    times: int = 1

    def _modulo(self) -> int:
        return self.modulo or 10**self.width

    def spark(self, key: str) -> Column:
        return F.lpad(((F.col(key) * self.times) % self._modulo() + self.plus).cast("string"), self.width, "0")

    def sql(self, key: str) -> str:
        return f"lpad(cast(({key} * {self.times}) % {self._modulo()} + {self.plus} as varchar), {self.width}, '0')"


@dataclass(frozen=True)
class Found:
    category: str
    parts: tuple


Segment = str | Digits | Found


def found(category: str, *parts: str | Digits) -> Found:
    return Found(category, parts)


def _flat(segments: Sequence[Segment]) -> list[str | Digits]:
    return [p for s in segments for p in (s.parts if isinstance(s, Found) else (s,))]


def spark_text(segments: Sequence[Segment], key: str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.spark(key) for p in _flat(segments)], F.lit(""))


def sql_text(segments: Sequence[Segment], key: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join([quoted(p) if isinstance(p, str) else p.sql(key) for p in _flat(segments)] + ["''"])


def documents(rows: DataFrame, key: str, lines: dict[str, Sequence[Segment]]) -> DataFrame:
    """doc_id, line (its name) and text: every line for every row."""
    made = F.array(*[F.struct(F.lit(name).alias("line"), spark_text(s, key).alias("text")) for name, s in lines.items()])
    return rows.select(F.col(key).alias("doc_id"), F.explode(made).alias("m")).select("doc_id", "m.line", "m.text")


def expected_sql(table: str, key: str, lines: dict[str, Sequence[Segment]]) -> str:
    """The findings of these documents: doc_id, line, category, value and begin."""
    out = []
    for name, segments in lines.items():
        for i, s in enumerate(segments):
            if isinstance(s, Found):
                out.append(f"select {key} as doc_id, '{name}' as line, '{s.category}' as category, {sql_text([s], key)} as value, cast(length({sql_text(segments[:i], key)}) as integer) as begin from {table}")
    return "\nunion all ".join(out)
