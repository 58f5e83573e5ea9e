"""What a case gets back: rewritten office documents, archives, a report, the log of feedback, the party list."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.literals import bounded
from ..storage import partitions_for

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_T, _P, _DELETED = f"{{{_W}}}t", f"{{{_W}}}p", f"{{{_W}}}delText"
#: Parts of a document that hold text, and those whose contents tell who wrote it and when.
_TEXT_PARTS = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml")
_PROPERTIES = re.compile(r"docProps/(core|app|custom)\.xml")
_AUTHOR = (f"{{{_W}}}author", f"{{{_W}}}initials")


def _rewrite_paragraph(node: ElementTree.Element, pattern: re.Pattern, made: dict[str, str]) -> int:
    """Replace values in a paragraph's text, wherever its runs cut them: the new text stands in the run where the
    value began. The number of replacements."""
    runs = [t for t in node.iter() if t.tag in (_T, _DELETED)]
    texts = [t.text or "" for t in runs]
    whole = "".join(texts)
    found = list(pattern.finditer(whole))
    for m in reversed(found):
        new, at = made[" ".join(m[0].split()).lower()], 0
        for i, t in enumerate(texts):
            a, b = max(m.start(), at), min(m.end(), at + len(t))
            if a < b or (a == b == m.start() and not t):
                texts[i] = t[: a - at] + (new if a == m.start() else "") + t[b - at :]
            at += len(t)
    for t, text in zip(runs, texts, strict=True):
        if t.text != text and (t.text or text):
            t.text = text
            t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return len(found)


def rewrite_docx(data: bytes, replacements: dict[str, str]) -> tuple[bytes, int]:
    """(the document with every value replaced, the number of replacements). Text in revisions, notes, comments,
    headers and footers is rewritten too; names of authors are blanked and properties emptied."""
    listed = sorted((v for v in replacements if v.strip()), key=lambda v: (-len(v), v))
    pattern = re.compile("|".join(bounded(v) for v in listed) or r"(?!)", re.IGNORECASE)
    made = {" ".join(v.split()).lower(): replacements[v] for v in reversed(listed)}
    out, n = io.BytesIO(), 0
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in old.infolist():
            raw = old.read(item.filename)
            if _TEXT_PARTS.fullmatch(item.filename):
                read = ElementTree.iterparse(io.BytesIO(raw), events=["start-ns"])
                for _, (prefix, uri) in read:
                    ElementTree.register_namespace(prefix, uri) if not re.fullmatch(r"ns\d+", prefix) else None
                root = read.root
                n += sum(_rewrite_paragraph(p, pattern, made) for p in root.iter(_P))
                for x in root.iter():
                    for a in _AUTHOR:
                        if a in x.attrib:
                            x.set(a, "")
                raw = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            elif _PROPERTIES.fullmatch(item.filename):
                root = ElementTree.fromstring(raw)
                for x in root.iter():
                    x.text = None
                raw = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
            new.writestr(item.filename, raw)
    return out.getvalue(), n


def rewrite_files(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """path, content and replaced of the office documents in files (set_id, path, content), rewritten by their
    case's mapping (set_id, canonical, replacement), which is some hundreds of values. A file without a
    mapping, or that is no office document, comes back as it is, with 0."""
    per_set = mapping.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "replacement"))).alias("made"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, made in zip(pdf["path"], pdf["content"], pdf["made"], strict=True):
                try:
                    out.append((path, *(rewrite_docx(content, dict(made)) if made and path.lower().endswith(".docx") else (content, 0))))
                except (zipfile.BadZipFile, ElementTree.ParseError):
                    out.append((path, content, 0))
            yield pd.DataFrame(out, columns=["path", "content", "replaced"])

    rows = files.join(per_set, "set_id", "left").select("path", "content", "made")
    rows = rows.repartition(partitions_for(rows), "path")  # small in bytes, long in work
    return rows.mapInPandas(run, "path string, content binary, replaced long")


def archives(files: DataFrame) -> DataFrame:
    """set_id and archive: a case's files (set_id, name, content) as one zip file, in order of their names. A case
    is tens to hundreds of files, so it is one group; cases are many."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in sorted(zip(pdf["name"], pdf["content"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), content)
        return pd.DataFrame({"set_id": [pdf["set_id"].iloc[0]], "archive": [out.getvalue()]})

    return files.select("set_id", "name", "content").groupBy("set_id").applyInPandas(pack, f"set_id {files.schema['set_id'].dataType.simpleString()}, archive binary")


def run_report(files: DataFrame, hits: DataFrame, settings: dict[str, str]) -> DataFrame:
    """section, key and value of a run: its settings, files by status (files: path, status), hits by category
    (hits: category, replacement) and different replacements by category."""
    spark = files.sparkSession
    rows = spark.createDataFrame([("settings", k, v) for k, v in sorted(settings.items())], "section string, key string, value string")
    by = lambda df, section, key, value: df.select(F.lit(section).alias("section"), F.col(key).alias("key"), value.cast("string").alias("value"))
    status = files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    kinds = hits.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("replacement").alias("d"))
    rows = rows.unionByName(by(status, "files", "status", F.col("n"))).unionByName(by(kinds, "hits", "category", F.col("n")))
    return rows.unionByName(by(kinds, "replacements", "category", F.col("d")))


def log_feedback(reports: DataFrame, path: str) -> None:
    """Append what users report to the log, a line of JSON each."""
    reports.write.mode("append").json(path)


def party_list(rows: DataFrame) -> DataFrame:
    """Role, Field, Value, Detail, File, Page and Times found as text that no spreadsheet runs, in the order in
    which a reader looks for them."""
    safe = lambda c: X.spreadsheet_safe(F.coalesce(F.col(c).cast("string"), F.lit("")))
    named = {"Role": "role", "Field": "field", "Value": "value", "Detail": "detail", "File": "file", "Page": "page", "Times found": "times"}
    return rows.orderBy("role", "field", "value").select(*[safe(c).alias(n) for n, c in named.items()])


def write_party_list(rows: DataFrame, path: str) -> None:
    party_list(rows).write.mode("overwrite").option("header", "true").csv(path)
