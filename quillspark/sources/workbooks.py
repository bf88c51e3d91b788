"""Workbooks of students and teachers: sheets as rows, columns by their headers, and what becomes of each row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.school import class_assignment, division, phone, standard

# fixed values: for each column the words that a header holds (any one list in whole), in the order in which a header is
# tried; "free" columns are only taken from a header while no earlier one has given them
STUDENT_COLUMNS = (("name", (("student", "name"),), False), ("name", (("name",),), True), ("gr_number", (("gr",),), False), ("roll_number", (("roll",),), False), ("standard", (("standard",), ("class",)), False), ("division", (("div",), ("sec",)), False), ("phone", (("phone",), ("mobile",)), False))
TEACHER_COLUMNS = (("name", (("teacher", "name"),), False), ("name", (("name",),), True), ("phone", (("phone",), ("mobile",)), False), ("subject", (("subject",),), False), ("class_teacher", (("class teacher",), ("in-charge",)), False))
STUDENT_NEEDS = ("name", "gr_number", "standard", "division", "phone")
TEACHER_NEEDS = ("name", "phone", "subject")

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def columns_of(headers: list[str | None], rules: tuple = STUDENT_COLUMNS) -> dict[str, int]:
    """The place of each known column among the headers. Of several headers for a column the last counts, but a plain
    name only while there is none."""
    out: dict[str, int] = {}
    for place, header in enumerate(headers):
        low = (header or "").strip().lower()
        for column, ways, free in rules:
            if any(all(word in low for word in way) for way in ways) and not (free and column in out):
                out[column] = place
                break
    return out


def _number(text: str) -> str:
    """A number as it is shown: whole ones without a point."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of the rows of the active sheet of a workbook, read one after the other; formulas by their results."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets, view = book.findall(f"{_NS}sheets/{_NS}sheet"), book.find(f"{_NS}bookViews/{_NS}workbookView")
        sheet = sheets[int(view.get("activeTab", 0)) if view is not None else 0]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[sheet.get(_LINK)]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        number = 0
        with z.open(path) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for cell in row.iter(f"{_NS}c"):
                    letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                    place = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value, kind = cell.find(f"{_NS}v"), cell.get("t", "n")
                    if kind == "inlineStr":
                        cells[place] = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
                    elif value is not None and value.text is not None:
                        cells[place] = shared[int(value.text)] if kind == "s" else _number(value.text) if kind == "n" else value.text
                yield number, cells
                row.clear()


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, cells, error): the rows of the active sheet of each workbook (.xlsx) under a path, numbered from 1.

    Files are read where they are, one to a task and more; a file that is no workbook gives one row with an error.
    """

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = list(sheet_rows(content))
                    yield pd.DataFrame({"path": name, "row": [r for r, _ in rows], "cells": [c for _, c in rows], "error": None})
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError) as e:
                    yield pd.DataFrame({"path": [name], "row": [0], "cells": [None], "error": [f"{type(e).__name__}: {e}"]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, row int, cells array<string>, error string")


def _columns(headers: Column, rules: tuple) -> Column:
    """The map of column to place (from 0), by the rules of `columns_of`."""
    low = F.transform(headers, lambda h: F.lower(F.trim(F.coalesce(h, F.lit("")))))

    def step(found: Column, h: Column) -> Column:
        named = F.lit(None).cast("string")
        for column, ways, free in reversed(rules):
            test = F.lit(False)
            for way in ways:
                test = test | F.forall(F.array(*map(F.lit, way)), lambda w: h["text"].contains(w))
            named = F.when(test & ~F.map_contains_key(found, F.lit(column)) if free else test, column).otherwise(named)
        kept = F.map_filter(found, lambda k, _: k != F.coalesce(named, F.lit("")))
        return F.when(named.isNull(), found).otherwise(F.map_concat(kept, F.map_from_arrays(F.array(named), F.array(h["place"]))))

    places = F.transform(low, lambda t, i: F.struct(t.alias("text"), i.alias("place")))
    return F.aggregate(places, F.create_map().cast("map<string,int>"), step)


def by_headers(sheets: DataFrame, rules: tuple = STUDENT_COLUMNS, needs: tuple = STUDENT_NEEDS) -> DataFrame:
    """(path, row, columns of the rules, error): the rows below the headers, which stand in the first row of each sheet.

    sheets: (path, row, cells, error). Cells are trimmed, empty ones null; rows without any value are left out. A sheet
    that lacks a needed column, or has no rows, gives one row with an error.
    """
    names = list(dict.fromkeys(c for c, _, _ in rules))
    heads = sheets.where("error is null").groupBy("path").agg(F.min("row").alias("first"), F.min_by("cells", "row").alias("headers"), F.max("row").alias("last"))
    heads = heads.withColumn("at", _columns(F.col("headers"), rules))
    missing = F.filter(F.array(*map(F.lit, needs)), lambda n: ~F.map_contains_key(F.col("at"), n))
    heads = heads.withColumn("error", F.when(F.col("last") <= F.col("first"), "no data rows").when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))))
    # headers are one row for each file; their rows meet them by path
    rows = sheets.where("error is null").select("path", "row", "cells").join(heads.select("path", "first", "at", "error"), "path").where("error is null and row > first")
    cell = lambda n: F.nullif(F.trim(F.get("cells", F.try_element_at("at", F.lit(n)))), F.lit(""))
    rows = rows.where(F.exists("cells", lambda c: F.coalesce(c != "", F.lit(False)))).select("path", "row", *(cell(n).alias(n) for n in names), F.lit(None).cast("string").alias("error"))
    nothing = [F.lit(None).cast("string").alias(n) for n in names]
    failed = heads.where("error is not null").select("path", F.col("first").alias("row"), *nothing, "error")
    return rows.unionByName(failed).unionByName(sheets.where("error is not null").select("path", "row", *nothing, "error"))


def checked_students(rows: DataFrame) -> DataFrame:
    """Rows of students with standard, division and phone in their normal forms, and `error` naming the first value that
    is missing or wrong: name, gr_number, standard, division or phone."""
    made = rows.withColumns({"standard": standard(F.col("standard")), "division": division(F.col("division")), "phone": phone(F.col("phone"))})
    wrong = F.coalesce(F.col("error"), *(F.when(F.col(c).isNull(), c) for c in STUDENT_NEEDS))
    return made.withColumn("error", wrong)


def checked_teachers(rows: DataFrame) -> DataFrame:
    """Rows of teachers with their phone in its normal form, `assignment` of their class, and `error` as for students."""
    made = rows.withColumns({"phone": phone(F.col("phone")), "assignment": class_assignment(F.col("class_teacher"))})
    return made.withColumn("error", F.coalesce(F.col("error"), *(F.when(F.col(c).isNull(), c) for c in TEACHER_NEEDS)))
