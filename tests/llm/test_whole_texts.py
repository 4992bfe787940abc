"""Licences of whole texts, and results that must not depend on line breaks, sizes or partitions."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logweave.llm import license_scan

PROSE = " ".join(f"p{i % 97}q{i % 13}" for i in range(120))


def licence(name):
    return Path(license_scan.__file__).with_name("licences").joinpath(f"{name}.txt").read_text()


def scanned(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, path string")
    return {r["doc_id"]: (r["license"], r["via"]) for r in license_scan.scan(frame, F.col("path")).collect()}


def test_a_wrapped_licence_file_licenses_its_directory(spark):
    mit = licence("MIT").replace("<year> <copyright holders>", "1999 Some Body")
    got = scanned(spark, [(1, mit, "a/b/LICENSE"), (2, PROSE, "a/b/c/x"), (3, PROSE, "a/y"), (4, licence("BSD-3-Clause"), "d/LICENSE"), (5, PROSE, "d/x"), (6, PROSE + "\n" + mit[:500] + "\n" + PROSE, "e/x"), (7, PROSE, "e/y")])
    assert got == {1: ("MIT", "header"), 2: ("MIT", "inherited"), 3: (None, "none"), 4: ("BSD-3-Clause", "header"), 5: ("BSD-3-Clause", "inherited"), 6: ("MIT", "header"), 7: (None, "none")}


def test_a_notice_wrapped_over_lines_is_found(spark):
    text = PROSE + "\n# This Source Code Form is subject to the terms\n# of the Mozilla Public\n#\n# License, version 2.0.\n" + PROSE
    assert scanned(spark, [(1, text, "a/x"), (2, PROSE, "a/y")]) == {1: ("MPL-2.0", "header"), 2: (None, "none")}


@pytest.mark.parametrize("name", ["GPL-3.0", "Apache-2.0"])
def test_long_licence_files_license_their_directory(spark, name):
    assert len(licence(name)) > 4000
    assert scanned(spark, [(1, licence(name), "a/LICENSE"), (2, " ".join(licence(name).split()), "b/LICENSE"), (3, PROSE, "a/x"), (4, PROSE, "b/x")]) == {1: (name, "header"), 2: (name, "header"), 3: (name, "inherited"), 4: (name, "inherited")}


def test_a_notice_inside_a_long_line_is_found(spark):
    for around in (PROSE, " ".join([PROSE] * 20)):
        text = f"{around} Released under the MIT License {around}"
        assert scanned(spark, [(1, text, "a/x"), (2, PROSE, "a/y")]) == {1: ("MIT", "header"), 2: (None, "none")}


def test_a_long_file_of_one_notice_licenses_its_directory(spark):
    text = "Licensed under the MIT License." + " - " * 1500 + "\n"
    assert scanned(spark, [(1, text, "a/x"), (2, PROSE, "a/y")]) == {1: ("MIT", "header"), 2: ("MIT", "inherited")}
