"""Scalar functions: parsing of git texts, labels, rounding, paths and names. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an identity line of a commit header: name and address, seconds, offset.
AUTHORSHIP = r"^((.*) <(.*)>) ([0-9]+) ([-+][0-9]{4})$"


def authorship(line: Column) -> Column:
    """{author, name, email, timestamp, tz_info} of an identity line; all null if it isn't one."""
    fits = line.rlike(AUTHORSHIP)
    part = lambda i: F.when(fits, F.regexp_extract(line, AUTHORSHIP, i))
    return F.struct(part(1).alias("author"), part(2).alias("name"), part(3).alias("email"), part(4).cast("bigint").alias("timestamp"), part(5).alias("tz_info"))


def file_mode(header: Column, side: str) -> Column:
    """File mode of the ``pre`` or ``post`` image in the extended header lines of a diff; null if it isn't told."""
    same = F.regexp_extract(header, r"(?m)^index [0-9a-f.]+ ([0-7]{6})$", 1)
    own = F.regexp_extract(header, r"(?m)^(?:old|deleted file) mode ([0-7]{6})$" if side == "pre" else r"(?m)^(?:new|new file) mode ([0-7]{6})$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(same, F.lit("")))


def strip_prefix(path: Column) -> Column:
    """A path in a diff without its ``a/`` or ``b/``."""
    return F.regexp_replace(path, "^[ab]/", "")


def shortlog(line: Column) -> Column:
    """{count, author} of a line of ``git shortlog -s``."""
    return F.struct(F.trim(F.split_part(line, F.lit("\t"), F.lit(1))).cast("bigint").alias("count"), F.split_part(line, F.lit("\t"), F.lit(2)).alias("author"))


def name_status(status: Column, first: Column, second: Column) -> Column:
    """{old, new} paths of an entry of ``git diff --name-status``: A has no old one, D no new one, R and C have two."""
    kind = F.substring(status, 1, 1)
    old = F.when(kind == "A", None).otherwise(first)
    new = F.when(kind == "D", None).when(kind.isin("R", "C"), second).otherwise(first)
    return F.struct(old.alias("old"), new.alias("new"))


def format_version(path: Column) -> Column:
    """Version of an annotation file by its suffixes: ``.v1.json``, ``.v1.5.json``, ``.v2.json``; v1.5 if there is none."""
    name = F.lower(F.regexp_extract(path, r"[^/]*$", 0))
    return F.when(name.rlike(r"\.v2\.json$"), "v2").when(name.rlike(r"\.v1\.5\.json$"), "v1.5").when(name.rlike(r"\.v1\.json$"), "v1").otherwise("v1.5")


def clean_text(text: Column) -> Column:
    r"""A text without ``*``, ``/``, ``\``, tabs and line ends, its blanks squeezed."""
    return F.regexp_replace(F.translate(text, "*/\\\t\n", ""), r"\s+", " ")


def tz_seconds(offset: Column) -> Column:
    """Seconds of an offset like ``-0530``; null if it isn't one."""
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    value = sign * (F.substring(offset, 2, 2).cast("int") * 3600 + F.substring(offset, 4, 2).cast("int") * 60)
    return F.when(offset.rlike(r"^[-+]\d{4}$"), value)


def round_10s(x: Column) -> Column:
    """``x`` rounded up to one significant digit; 1 for null and what isn't positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    return F.when(x > 0, F.ceil(x / power) * power).otherwise(1.0)


def width_limit(total: Column) -> Column:
    """A tenth of ``total`` rounded down to one significant digit; 0 stays."""
    tenth = total / 10
    power = F.pow(F.lit(10.0), F.floor(F.log10(tenth)))
    return F.when(tenth > 0, F.floor(tenth / power) * power).otherwise(0.0)


def avatar_url(email: Column, size: int = 16) -> Column:
    """The Gravatar address of an e-mail address: the SHA-256 of its lower-case form."""
    return F.concat(F.lit("https://www.gravatar.com/avatar/"), F.sha2(F.lower(F.trim(email)), 256), F.lit(f"?s={size}&d=retro"))


def depth(path: Column) -> Column:
    """Parts of a path; ``.`` and the empty path have none."""
    return F.when(path.isin("", "."), 0).otherwise(F.size(F.split(path, "/")))


def shorten(path: Column, parts: int) -> Column:
    """A path of more than ``parts`` parts as its first ones and ``/**``."""
    return F.when(depth(path) > parts, F.concat(F.substring_index(path, "/", parts), F.lit("/**"))).otherwise(path)


def parent(path: Column) -> Column:
    """The directory of a path, ``.`` for a bare name."""
    return F.when(path.contains("/"), F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit(""))).otherwise(".")


def adjusted_depth(path: Column) -> Column:
    """Parts of a path, of which a last ``*`` is none."""
    return depth(path) - F.endswith(path, F.lit("/*")).cast("int")


def adjusted_name(path: Column) -> Column:
    """The last part of a path; with ``*`` or ``**`` after it if it ends so, and after dots, one for each part."""
    stem = F.regexp_replace(path, r"/\*{1,2}$", "")
    tail = F.substr(path, F.length(F.regexp_extract(stem, r"^(.*/)?", 0)) + 1)
    return F.when(stem.contains("/"), F.concat(F.repeat(F.lit("."), adjusted_depth(path)), tail)).otherwise(path)


def ancestors(path: Column) -> Column:
    """Array of {parent, child} links from a path up to the root ``.``; an absolute path ends at ``/``."""
    absolute = path.startswith("/")
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    at = lambda i: F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    top = F.when(absolute, F.lit("/")).otherwise(F.lit("."))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.when(i == 1, top).otherwise(at(i - 1)).alias("parent"), at(i).alias("child")))


def line_kind(text: Column) -> Column:
    """``empty``, ``whitespace``, ``comment`` or ``code`` of a raw line, by its text alone."""
    return (
        F.when(F.rtrim(F.regexp_replace(text, r"[\r\n]+$", "")).eqNullSafe(F.lit("")) & (F.length(F.regexp_replace(text, r"[\r\n]+$", "")) == 0), "empty")
        .when(F.regexp_replace(text, r"\s+", "") == "", "whitespace")
        .when(text.rlike(r"^\s*(#(?!include)|//|/\*|\*|--|;)"), "comment")
        .otherwise("code")
    )


def thousands(x: Column) -> Column:
    """An integer with separators of thousands."""
    return F.format_number(x, 0)
