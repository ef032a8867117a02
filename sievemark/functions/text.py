"""Paths, texts, licenses and addresses as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UNASSIGNED = "UNASSIGNED"
# The names of splits, and what a path may call them.
SPLITS = ("train", "val", "test")
SPLIT_WORDS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}
# Image suffixes.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
# License words that restrict use.
RESTRICTED = ("nc", "nd", "noncommercial", "noderivatives")
RESTRICTED_PHRASES = ("non-commercial", "no derivatives")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$")


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def class_of_path(path: Column, known: list[str], default: str | None = None) -> Column:
    """The nearest folder above the file that is a known class."""
    folders = parts(path)
    above = F.reverse(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))))
    return F.coalesce(F.get(F.filter(above, lambda x: x.isin(known)), 0), F.lit(default or UNASSIGNED))


def source_of_path(path: Column) -> Column:
    return F.when(F.size(parts(path)) > 1, F.get(parts(path), 0)).otherwise("local")


def split_of_path(path: Column) -> Column:
    first = F.get(parts(path), 0)
    return F.when(first.isin(*SPLITS), first).otherwise(UNASSIGNED)


def source_split(path: Column) -> Column:
    """The last part of a path that names a split; train without one."""
    names = F.create_map(*[F.lit(x) for pair in SPLIT_WORDS.items() for x in pair])
    found = F.filter(F.transform(F.reverse(parts(path)), lambda x: names[F.lower(x)]), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit("train"))


def output_split(split: Column, policy: Column) -> Column:
    return F.when(policy == "bootstrap_train_only", "train").otherwise(split)


def quality_flags(width: Column, height: Column, class_name: Column, least_width: int = 640, least_height: int = 480, most_aspect: float = 4.0) -> Column:
    aspect = F.greatest(F.try_divide(width.cast("double"), height), F.try_divide(height.cast("double"), width))
    flags = [
        F.when(width < least_width, "LOW_WIDTH"),
        F.when(height < least_height, "LOW_HEIGHT"),
        F.when(aspect > most_aspect, "EXTREME_ASPECT_RATIO"),
        F.when(class_name == UNASSIGNED, "UNASSIGNED_CLASS"),
    ]
    return F.array_join(F.filter(F.array(*flags), lambda x: x.isNotNull()), "|")


def strip_tags(text: Column) -> Column:
    """Tags to spaces, white space to single spaces; entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def clean_html(text: Column) -> Column:
    """Without tags, entities unescaped (which has no built-in function), white space to single spaces."""
    plain = _unescaped(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def safe_stem(text: Column, most: int = 96) -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    plain = F.regexp_replace(F.regexp_replace(text, "File:", ""), "[^0-9A-Za-z._-]+", "_")
    plain = F.regexp_replace(plain, r"^[._-]+|[._-]+$", "")
    return F.substring(F.when(plain == "", "image").otherwise(plain), 1, most)


def is_safe_relative_path(path: Column) -> Column:
    """Not blank, not absolute, without a drive and without steps upwards."""
    plain = F.regexp_replace(path, r"\\", "/")
    return F.coalesce((F.trim(path) != "") & ~plain.rlike("^/") & ~plain.rlike("^[A-Za-z]:") & ~plain.rlike(r"(^|/)\.\.(/|$)") & ~plain.rlike(r"^\.?/*$"), F.lit(False))


def sha256_or_null(text: Column) -> Column:
    """Lower-case digest, null if it isn't one."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def license_allowed(name: Column, prefixes: list[str]) -> Column:
    plain = F.trim(F.replace(F.lower(name), F.lit("_"), F.lit(" ")))
    ok = F.lit(False)
    for x in prefixes:
        ok = ok | plain.startswith(x.lower().replace("_", " "))
    for x in RESTRICTED_PHRASES:
        ok = ok & ~plain.contains(x)
    return F.coalesce(ok & ~F.arrays_overlap(F.split(plain, "[^a-z0-9]+"), F.array(*map(F.lit, RESTRICTED))), F.lit(False))


def license_problem(license_name: Column, url: Column, terms: Column, artist: Column, credit: Column, prefixes: list[str]) -> Column:
    """The first reason against a license's metadata; null if there is none."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    missing = F.array_join(F.filter(F.array(F.when(blank(license_name), "license"), F.when(blank(url), "license_url"), F.when(blank(terms), "usage_terms")), lambda x: x.isNotNull()), ",")
    return (
        F.when(missing != "", F.concat(F.lit("missing_license_metadata:"), missing))
        .when(blank(artist) & blank(credit), "missing_license_metadata:artist_or_credit")
        .when(~url.rlike("^https?://[^/]+"), "invalid_license_url")
        .when(~license_allowed(license_name, prefixes), F.concat(F.lit("license_not_allowed:"), license_name))
    )


def keywords_allow(title: Column, include: list[str], exclude: list[str]) -> Column:
    plain = F.lower(title)
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: plain.contains(w))
    ok = any_of([x.lower() for x in include]) if include else F.lit(True)
    return ok & ~any_of([x.lower() for x in exclude]) if exclude else ok


def url_problem(url: Column, hosts: list[str], label: str = "url") -> Column:
    """The first reason against an address; null if it may be fetched."""
    plain = F.trim(F.coalesce(url, F.lit("")))
    rest = F.regexp_extract(plain, r"^[^:/?#]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), r":[^:\]]*$", ""), r"\.$", ""))
    port = F.regexp_extract(rest, r":([^:@\]]*)$", 1)
    number = port.try_cast("int")
    why = (
        F.when(plain == "", "missing_url")
        .when(~plain.rlike("(?i)^https://"), "https_required")
        .when(rest.contains("@"), "credentials_forbidden")
        .when((port != "") & ~(port.rlike("^[0-9]+$") & F.coalesce(number <= 65535, F.lit(False))), "invalid_port")
        .when((port != "") & (number != 443), F.concat(F.lit("port_not_allowed:"), number.cast("string")))
        .when(~host.isin(hosts), F.concat(F.lit("host_not_allowed:"), F.when(host == "", "missing").otherwise(host)))
        .when(plain.rlike("#."), "fragment_forbidden")
        .when(~plain.rlike("^[^:/?#]+://[^/?#]+/"), "invalid_path")
    )
    return F.concat(F.lit(f"{label}:"), why)


def utc_or_null(text: Column) -> Column:
    """A timestamp written as 2024-01-31T12:00:00Z; null if it isn't one."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def sniffed_mime(content: Column) -> Column:
    """JPEG, PNG or WebP by a file's first bytes, else an empty text."""
    at = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when(at(1, 3) == "FFD8FF", "image/jpeg")
        .when(at(1, 8) == "89504E470D0A1A0A", "image/png")
        .when((at(1, 4) == "52494646") & (at(9, 4) == "57454250"), "image/webp")
        .otherwise("")
    )


@F.pandas_udf(StringType())
def mediawiki_sha1(values: pd.Series) -> pd.Series:
    """40 hex digits of a SHA-1 in hex or base 36 (160 bits are too many for a built-in function); else null."""

    def one(value: str) -> str | None:
        text = value.strip().lower()
        if len(text) == 40 and all(c in "0123456789abcdef" for c in text):
            return text
        if text.isascii() and text.isalnum() and 1 <= len(text) <= 31 and (number := int(text, 36)) < 1 << 160:
            return f"{number:040x}"
        return None

    return values.map(one, na_action="ignore")


def model_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def canonical_text(text: Column) -> Column:
    """Line ends as LF, no byte-order mark."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-?]*[ -/]*[@-~]", "")


# A path that begins a text or follows a character that can't be in one.
WINDOWS_PATH = r"(?i)(^|[\s\"'(=,;])([a-z]:[\\/][^\s\"'<>|]*)"
POSIX_PATH = r"(^|[\s\"'(=,;])(/(?:home|root|users|tmp|var|mnt|opt|usr|etc|srv|data)/[^\s\"'<>|]*)"
USER_HOME = r"(?i)[a-z]:[\\/]users[\\/][^\\/\s\"']+|/(?:home|users)/[^/\s\"']+"


def redacted(text: Column, names: dict[str, str] | None = None) -> Column:
    """Named strings replaced, then users' homes, then other absolute paths."""
    for name, to in (names or {}).items():
        text = F.regexp_replace(text, F.lit(rf"(?i)\Q{name}\E"), F.lit(to))
    text = F.regexp_replace(text, USER_HOME, "<USER_HOME>")
    return F.regexp_replace(F.regexp_replace(text, WINDOWS_PATH, "$1<ABSOLUTE_PATH>"), POSIX_PATH, "$1<ABSOLUTE_PATH>")


def has_local_path(text: Column) -> Column:
    return text.rlike(WINDOWS_PATH) | text.rlike(POSIX_PATH)


def gflops(value: Column, summary: Column) -> Column:
    """The value, or the figure before GFLOPs in a summary."""
    return F.coalesce(value, F.regexp_extract(summary, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*GFLOPs", 1).try_cast("double"))


def known_stat(value: Column) -> Column:
    """Null for the negative value that says a statistic doesn't exist."""
    return F.when(value >= 0, value)


def review_status(score: Column, manual: Column, by_name: Column, by_id: Column, overall: Column) -> Column:
    """Against the first threshold there is."""
    threshold = F.coalesce(manual, by_name, by_id, overall)
    return F.when(score >= threshold, "high_confidence_candidate").otherwise("review_required")
