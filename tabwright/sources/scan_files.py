"""Safety scan of a folder of files: extension, name, size, header bytes and suspicious strings anywhere in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.urls import ALLOWED, base_name, extension_of, file_name_problem

MAX_BYTES = 1024**3
HEADER_BYTES = 64  # longer than every signature

# First bytes of executables, scripts and archives.
SIGNATURES = [
    (b"MZ", "windows_executable"),
    (b"\x7fELF", "linux_executable"),
    (b"\xca\xfe\xba\xbe", "mach_o_or_java_class"),
    (b"\xfe\xed\xfa\xcf", "mach_o_executable"),
    (b"\xcf\xfa\xed\xfe", "mach_o_executable"),
    (b"#!", "shebang_script"),
    (b"<?php", "php_script"),
    (b"<%", "server_page_script"),
    (b"<script", "html_script"),
    (b"Rar!", "rar_archive"),
    (b"7z\xbc\xaf\x27\x1c", "seven_zip_archive"),
]
ZIP = b"PK\x03\x04"  # allowed, but marked

# Strings that only raise a flag.
SUSPICIOUS = [
    "eval(", "exec(", "system(", "os.system", "subprocess.call", "__import__", "import os", "import subprocess",
]


def _starts(code: bytes) -> Column:
    return F.startswith(F.col("header"), F.lit(bytearray(code)))


def scan_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, problem (null when safe), is_zip and suspicious.

    Oversized files are judged by their length alone; their content is not loaded.
    """
    options = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = options.load(path)
    large = options.load(path).where(F.col("length") > MAX_BYTES)
    text = F.lower(F.decode("content", "ISO-8859-1"))
    found = F.lit(False)
    for word in SUSPICIOUS:
        found = found | text.contains(word)
    small = files.where(F.col("length") <= MAX_BYTES).select(
        "path", "length", F.substring("content", 1, HEADER_BYTES).alias("header"), found.alias("suspicious")
    )
    signature = F.lit(None).cast("string")
    for code, label in reversed(SIGNATURES):
        signature = F.when(_starts(code), label).otherwise(signature)
    name = base_name(F.col("path"))
    refused = F.when(~extension_of(name).isin(ALLOWED), "extension").otherwise(file_name_problem(name))
    checked = small.select(
        "path",
        "length",
        F.coalesce(refused, signature).alias("problem"),
        _starts(ZIP).alias("is_zip"),
        "suspicious",
    )
    too_large = large.select(
        "path",
        "length",
        F.coalesce(refused, F.lit("too_large")).alias("problem"),
        F.lit(False).alias("is_zip"),
        F.lit(False).alias("suspicious"),
    )
    return checked.unionByName(too_large)
