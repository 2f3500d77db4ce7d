"""Intake packages on disk: one folder per applicant, one CSV per sheet.

Packages may order or omit columns freely, so sheets are read by name: every file is one small text (the
sheet of a single applicant) and a per-file helper turns it into ``name -> cell`` maps.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED_SHEETS = ("application",)
OPTIONAL_SHEETS = ("tradelines", "dpd_history", "account_months", "enquiries", "bank_statement")


def read_sheet(spark: SparkSession, root: str, sheet: str, columns: Sequence[str]) -> DataFrame:
    """All applicants' rows of one sheet as text columns; an absent column is NULL."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ref, text in zip(batch["applicant_ref"], batch["text"], strict=True):
                for number, row in enumerate(csv.DictReader(io.StringIO(text.lstrip("\ufeff")))):
                    cells = {k.strip().lower(): v for k, v in row.items() if k and v not in (None, "")}
                    rows.append((ref, number, cells))
            yield pd.DataFrame(rows, columns=["applicant_ref", "row_number", "cells"])

    texts = (
        spark.read.option("pathGlobFilter", f"{sheet}.csv")
        .option("recursiveFileLookup", True).text(root, wholetext=True)
        .select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("applicant_ref"),
                F.col("value").alias("text"))
    )
    parsed = texts.mapInPandas(parse, "applicant_ref string, row_number int, cells map<string,string>")
    return parsed.select("applicant_ref", *[F.col("cells")[c].alias(c) for c in columns if c != "applicant_ref"])


def missing_required(packages: DataFrame, application: DataFrame) -> DataFrame:
    """Packages without the required sheet."""
    return packages.join(application.select("applicant_ref").distinct(), "applicant_ref", "left_anti")
