"""URL and file-name rules as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that may be ingested, by class.
TABULAR = [".csv", ".xlsx", ".xls", ".json", ".parquet", ".feather", ".hdf5", ".h5", ".tsv"]
TEXTS = [".txt", ".md", ".log"]
IMAGES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".svg"]
AUDIO = [".wav", ".mp3", ".flac", ".aac", ".ogg", ".m4a", ".wma"]
ARCHIVES = [".zip", ".tar", ".gz", ".bz2", ".7z", ".rar"]
ALLOWED = TABULAR + TEXTS + IMAGES + AUDIO + ARCHIVES

# Host prefixes of private and local networks.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "10.", "192.168.", "169.254."] + [f"172.{i}." for i in range(16, 32)]

# File-name patterns that are refused (case-insensitive search).
DANGEROUS = [
    r"\.\.",
    r"[<>\"|?*]",
    r"^[.\s]",
    r"\.sh$",
    r"\.exe$",
    r"\.bat$",
    r"\.py[wc]?$",
    r"\.(dll|so|dylib)$",
]

# Where a URL points.
HOSTERS = {
    "kaggle": [r"kaggle\.com/datasets", r"kaggle\.com/competitions", r"kaggle\.com/code"],
    "github": [r"raw\.githubusercontent\.com", r"github\.com/.*/raw/", r"github\.com/.*/blob/"],
    "google_drive": [
        r"drive\.google\.com/file/d/",
        r"drive\.google\.com/open\?id=",
        r"drive\.google\.com/uc\?id=",
    ],
}
DIRECT_FILE = r"\.(csv|json|xlsx|zip|tar|gz|h5|parquet)(\?.*)?$"
MAX_NAME = 255


def any_match(column: Column, patterns: list[str]) -> Column:
    """One alternation, so a value is scanned once."""
    return column.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def file_class(extension: Column) -> Column:
    label = F.lit("unknown")
    for name, listed in (("tabular", TABULAR), ("text", TEXTS), ("image", IMAGES), ("audio", AUDIO)):
        label = F.when(extension.isin(listed), name).otherwise(label)
    return label


def extension_of(name: Column) -> Column:
    """Lower-case text from the last dot; empty when the dot leads or ends the name."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def percent_decoded(text: Column) -> Column:
    """Percent sequences decoded, a plus sign kept; text that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_class(url: Column) -> Column:
    label = F.lit("direct")
    for name, patterns in reversed(HOSTERS.items()):
        label = F.when(any_match(url, patterns), name).otherwise(label)
    return label


def is_direct_file(url: Column) -> Column:
    return any_match(url, [DIRECT_FILE])


def file_name_problem(name: Column) -> Column:
    """Why a file name is refused, or null."""
    decoded = percent_decoded(name)
    return F.when(F.length(decoded) > MAX_NAME, "too_long").when(any_match(decoded, DANGEROUS), "dangerous_pattern")


def sanitized_name(name: Column) -> Column:
    return F.regexp_replace(percent_decoded(name), r"[\\/:*?\"<>|\x00-\x1f]", "")


def url_problem(url: Column) -> Column:
    """Why a URL is refused, or null."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    well_formed = url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+\S*$")
    # host without user part and port
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    blocked = functools.reduce(lambda a, b: a | b, [host.startswith(h) for h in BLOCKED_HOSTS])
    path = percent_decoded(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    name = base_name(path)
    named_file = path.contains(".") & (name != "")
    return (
        F.when(~well_formed, "invalid_format")
        .when(~scheme.isin("http", "https"), "scheme")
        .when(blocked | host.isin([h.rstrip(".") for h in BLOCKED_HOSTS]), "blocked_host")
        .when(named_file & ~extension_of(name).isin(ALLOWED), "extension")
        .when(named_file, file_name_problem(name))
    )


def url_parts(url: Column) -> dict[str, Column]:
    """Download address, file name, and the ids of hosted files and datasets."""
    drive = F.coalesce(
        *[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"/file/d/([a-zA-Z0-9_-]+)", r"[?&]id=([a-zA-Z0-9_-]+)")]
    )
    dataset = r"kaggle\.com/datasets/([^/]+)/([^/?]+)"
    return {
        "download_url": F.when(url_class(url) == "github", F.replace(url, F.lit("/blob/"), F.lit("/raw/"))).otherwise(url),
        "file_name": base_name(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)),
        "drive_file_id": F.when(url_class(url) == "google_drive", drive),
        "kaggle_dataset": F.nullif(
            F.concat_ws("/", F.nullif(F.regexp_extract(url, dataset, 1), F.lit("")), F.nullif(F.regexp_extract(url, dataset, 2), F.lit(""))),
            F.lit(""),
        ),
    }
