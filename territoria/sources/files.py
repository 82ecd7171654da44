"""Files: delimited text with all columns as text, archives, JSON lines, XML, and optional workbooks and PDF."""

from __future__ import annotations

import csv
import importlib
import io
import zipfile
from collections.abc import Iterator
from itertools import islice
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.functions.text import column_name


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that lists the columns it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def delimited(spark: SparkSession, path: str, separator: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A delimited file with a header; every column is text, so codes keep their zeros. Without a separator it is read
    from the first line."""
    if separator is None:
        first = spark.read.text(path).limit(1).collect()
        separator = sniffed(first[0][0] if first else "")
    df = spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return required(df, columns).select(*columns) if columns else df


def sniffed(line: str) -> str:
    try:
        return csv.Sniffer().sniff(line, ";,\t|").delimiter
    except csv.Error:
        return ","


def distinct_names(names: list[str], fold: bool = True, keep: bool = False) -> list[str]:
    """Headers as identifiers, or as they are; repeated ones get a number."""
    out: list[str] = []
    for name in ((n.strip() if keep else column_name(n, fold)) or "column" for n in names):
        k, new = 0, name
        while new in out:
            k += 1
            new = f"{name}_{k}"
        out.append(new)
    return out


def archive_rows(spark: SparkSession, path: str, separator: str = ";", skip: str = "meta", every: bool = False) -> DataFrame:
    """(path, member, fields) of the delimited members of ZIP archives whose name lacks `skip`: the largest of each archive,
    or every one. fields maps a member's own column names to texts, so members of any headers go through one pass. An
    archive can't be split, so a task reads it as a stream; a field may span lines. A plain delimited file is its own only
    member; an archive without such a member gives no rows; a row's fields beyond its header are left out."""

    def members(name: str, content) -> Iterator[tuple[str, io.TextIOBase]]:
        if not zipfile.is_zipfile(pa.BufferReader(content)):
            yield name.rpartition("/")[2], io.TextIOWrapper(pa.BufferReader(content), "utf-8-sig", newline="")
            return
        with zipfile.ZipFile(pa.BufferReader(content)) as z:
            found = sorted((i for i in z.infolist() if i.filename.lower().endswith(".csv") and skip not in i.filename.lower()), key=lambda i: -i.file_size)
            for member in found if every else found[:1]:
                with z.open(member) as raw:
                    yield member.filename, io.TextIOWrapper(raw, "utf-8-sig", newline="")

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for part in parts:
            for name, content in zip(part.column("path").to_pylist(), part.column("content"), strict=True):
                for member, text in members(name, content.as_buffer()):
                    lines = csv.reader(text, delimiter=separator)
                    names = distinct_names(next(lines, []), keep=True)
                    while held := list(islice(lines, 10_000)):
                        held = [list(zip(names, (x or None for x in line), strict=False)) for line in held if line]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(held)), pa.array([member] * len(held)), pa.array(held, kind)], ["path", "member", "fields"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, member string, fields map<string, string>")


def archived(spark: SparkSession, path: str, separator: str = ";", skip: str = "meta", every: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The rows of archives (see archive_rows) as text columns, with path and member; a column that a member lacks is null.
    Without `columns`, the columns are all that any member has, by name: rows are kept while one aggregate finds them, so
    each archive is still opened once, whatever the number of headers."""
    rows = archive_rows(spark, path, separator, skip, every)
    if columns is None:
        rows = rows.persist()
        columns = sorted(rows.select(F.explode(F.map_keys("fields"))).distinct().toPandas().iloc[:, 0])  # a name for each column
    return rows.select("path", "member", *(F.col("fields")[c].alias(c) for c in columns))


def profiled(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(source_file, rows, columns, error, and mentions_<word> for each word) of the delimited files of a folder, in one
    pass: what the first line and the name of each file hold. A first line without a separator is an error in its row,
    and so is a file without any line."""
    text = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_name").alias("source_file"), F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("at"))
    found = text.groupBy("source_file").agg(F.min_by("value", "at").alias("header"), (F.count("*") - 1).alias("rows"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).inputFiles()  # scans leave files without bytes out, listings don't
    every = spark.createDataFrame([(unquote(f).rpartition("/")[2],) for f in listed], "source_file string")
    rows = every.distinct().join(found, "source_file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    hay = F.lower(F.concat_ws(" ", "source_file", "header"))
    return rows.select("source_file", "rows", F.col("header").alias("columns"), *(F.contains(hay, F.lit(w)).alias(f"mentions_{w}") for w in words), F.when(F.coalesce("header", F.lit("")) == "", "empty").when(~F.col("header").rlike(r"[;,\t|]"), "no separator").alias("error"))


def discovered(spark: SparkSession, folder: str, pattern: str = "*", words: list[str] = ()) -> DataFrame:
    """Files of a folder (path, length, modificationTime, sha256) by name pattern and words in the path."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    for w in words:
        df = df.where(F.contains(F.lower("path"), F.lit(w)))
    return df.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def xml_cells(df: DataFrame, column: str, schema: str, row_tag: str) -> DataFrame:
    """Elements of an XML text column as rows; attributes are fields whose names begin with an underscore."""
    return df.select(F.explode(F.from_xml(column, f"{row_tag} array<struct<{schema}>>")[row_tag]).alias("r")).select("r.*")


#: A document of local data: its data set, the variables with their modalities, and the cells. Attributes begin with an
#: underscore, an element's own text is _VALUE.
LOCAL_DATA = """JeuDonnees struct<_code string, Annee string, Libelle string, Source string>,
Variable array<struct<_code string, Libelle string, Modalite array<struct<_code string, Libelle string>>>>,
Cellule array<struct<Zone struct<_codgeo string, _nivgeo string>, Mesure struct<_code string, _VALUE string>, Modalite array<struct<_code string, _variable string>>, Valeur string>>"""


def local_data(df: DataFrame, column: str, source: str) -> DataFrame:
    """A row per cell of XML documents of local data (column), from where they came (source): source_url, the data set's code,
    year, label and source, geo_level, departement_code, measure_code, measure_label, modalities_json, value.

    A cell's modalities name their variable and code; labels are looked up among the document's own, the last of equal
    codes, and go into the JSON with them, null where there is none. A value that is no number is null, and so is what a
    document or cell lacks; a document without cells, or one that can't be read, gives no rows."""
    doc = df.select(F.col(source).alias("source_url"), F.from_xml(column, LOCAL_DATA).alias("d")).select("source_url", "d.*")
    labels = {
        "_variables": "transform(coalesce(Variable, array()), v -> struct(v._code as k, v.Libelle as l))",
        "_modalities": "flatten(transform(coalesce(Variable, array()), v -> transform(coalesce(v.Modalite, array()), m -> struct(concat_ws('|', v._code, m._code) as k, m.Libelle as l))))",
    }
    for name, entries in labels.items():  # one map for each document, of its last label by code
        doc = doc.withColumn(name, F.expr(f"filter({entries}, e -> e.k is not null)"))
        doc = doc.withColumn(name, F.expr(f"map_from_entries(filter({name}, (e, i) -> not exists(slice({name}, i + 2, size({name})), x -> x.k = e.k)))"))
    cells = doc.select("source_url", "JeuDonnees", *labels, F.explode("Cellule").alias("c"))
    modalities = F.expr("""transform(coalesce(c.Modalite, array()), m -> struct(m._variable as variable_code, _variables[m._variable] as variable_label,
      m._code as modality_code, _modalities[concat_ws('|', m._variable, m._code)] as modality_label))""")
    return cells.select(
        "source_url", *(F.col(f"JeuDonnees.{c}").alias(n) for c, n in (("_code", "dataset_code"), ("Annee", "dataset_year"), ("Libelle", "dataset_label"), ("Source", "dataset_source"))),
        F.col("c.Zone._nivgeo").alias("geo_level"), F.col("c.Zone._codgeo").alias("departement_code"), F.col("c.Mesure._code").alias("measure_code"), F.col("c.Mesure._VALUE").alias("measure_label"),
        F.to_json(modalities, {"ignoreNullFields": "false"}).alias("modalities_json"), F.col("c.Valeur").try_cast("double").alias("value"))


def monthly_index(df: DataFrame, column: str) -> DataFrame:
    """(period, value) of the monthly observations in SDMX documents."""
    series = F.from_xml(column, "DataSet struct<Series struct<Obs array<struct<_TIME_PERIOD string, _OBS_VALUE string>>>>")
    obs = df.select(F.explode(series["DataSet"]["Series"]["Obs"]).alias("o"))
    return obs.select(F.col("o._TIME_PERIOD").alias("period"), F.col("o._OBS_VALUE").try_cast("double").alias("value")).where(F.col("period").rlike(r"^\d{4}-\d{2}$") & F.col("value").isNotNull())


def nested_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, value) for the cells of workbooks that hold anything, so an empty sheet has no rows; needs
    openpyxl."""
    importlib.import_module("openpyxl")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from openpyxl import load_workbook

        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                for sheet in load_workbook(io.BytesIO(content), read_only=True, data_only=True):
                    rows = [(name, sheet.title, r, c, str(v)) for r, line in enumerate(sheet.iter_rows(values_only=True)) for c, v in enumerate(line) if v is not None]
                    yield pd.DataFrame(rows, columns=["path", "sheet", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, sheet string, row int, column int, value string")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, text) of PDF files, by their first bytes; others give no rows; needs pdfplumber."""
    importlib.import_module("pdfplumber")

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pdfplumber

        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                if bytes(content[:4]) != b"%PDF":
                    continue
                with pdfplumber.open(io.BytesIO(content)) as f:
                    yield pd.DataFrame([(name, k + 1, p.extract_text() or "") for k, p in enumerate(f.pages)], columns=["path", "page_number", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page_number int, text string")
