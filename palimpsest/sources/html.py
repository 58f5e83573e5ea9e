"""Text of web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text isn't shown, and elements that begin a new line.
HIDDEN = frozenset("script style noscript template head".split())
BLOCKS = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer nav blockquote pre".split())


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append("\t")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def to_text(page: str | None) -> str:
    """What a reader sees: one line for each block, no markup; empty for null."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def html_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id and text of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "text": [to_text(x) for x in pdf[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, text string")
