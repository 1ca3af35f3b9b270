"""Paths and URLs as expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a file index leaves out.
DENY_COMPONENTS = (".git", ".svn", ".hg", ".bzr", "node_modules", ".idea", ".vscode", ".cache", ".npm", ".yarn", ".pnpm-store")
DENY_CONTENT = ("cache", "upgrade", "wpcomsh-cache", "wflogs")
DENY_NAMES = (".DS_Store", "._.DS_Store", "Thumbs.db", "desktop.ini", "ehthumbs.db")
DENY_SUFFIXES = ("~", ".swp", ".swo", ".swn", ".bak", ".orig", ".rej")


def _any(names: tuple[str, ...]) -> str:
    return "(" + "|".join(map(re.escape, names)) + ")"


#: One pattern, so a scan tests a path once.
DENY = "|".join(
    [
        rf"(^|/){_any(DENY_COMPONENTS)}(/|$)",
        rf"(^|/)wp-content/{_any(DENY_CONTENT)}(/|$)",
        rf"(^|/){_any(DENY_NAMES)}$",
        r"(^|/)\.#[^/]+$",
        r"(^|/)#[^/]+#$",
        rf"{_any(DENY_SUFFIXES)}$",
    ]
)


def denied(path: Column) -> Column:
    return F.rlike(path, F.lit(DENY))


def valid(path: Column) -> Column:
    """Absolute, without NUL, without . or .. parts."""
    return F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\0")) & ~F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)"))


def normalized(path: Column) -> Column:
    """Resolve . and .. by text; the result is absolute."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def normalized_bare(path: Column) -> Column:
    """Resolve . and .. by text; the root is empty, a relative path stays relative, and its first part is never left."""

    def step(a: Column, x: Column) -> Column:
        up = F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)
        return F.when((x == "") | (x == "."), F.when(F.size(a) == 0, F.array(F.lit(""))).otherwise(a)).when(x == "..", up).otherwise(F.concat(a, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    up = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(up == "", "/").otherwise(up)


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, http and https only; null otherwise."""
    found = F.lower(F.regexp_extract(url, r"^([Hh][Tt][Tt][Pp][Ss]?://[^/?#\s]+)", 1))
    return F.when(found != "", found)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


# Extensions whose bodies shrink under gzip, and those whose bodies do not.
COMPRESSIBLE = tuple(
    "php phtml js jsx ts tsx mjs cjs css scss sass less html htm xml xsl xslt svg vue astro twig mustache hbs liquid "
    "json jsonl yaml yml toml csv tsv sql ini conf cfg env properties md markdown txt log rst adoc pot po rss atom srt vtt webvtt sh bash patch diff".split()
)
COMPRESSED = tuple(
    "zip gz tgz bz2 xz 7z rar tar jpg jpeg png gif webp heic heif avif tiff tif bmp ico mp3 m4a aac ogg opus flac wav "
    "mp4 m4v mov webm mkv avi woff woff2 ttf otf eot pdf psd sketch fig iso dmg mo phar".split()
)


def compressible(path: Column) -> Column:
    """yes, no or unknown by extension; files without one, and dotfiles, are text, and a path without a name is not."""
    base = basename(F.regexp_replace(path, "/+$", ""))
    ext = F.lower(F.regexp_extract(base, r"\.([^.]*)$", 1))
    plain = (ext == "") | F.rlike(base, F.lit(r"^\.[^.]*$"))
    return F.when(base == "", "no").when(plain | ext.isin(*COMPRESSIBLE), "yes").when(ext.isin(*COMPRESSED), "no").otherwise("unknown")


def resolved(parent: Column, target: Column) -> Column:
    """Where a link in ``parent`` leads by its text: an absolute target as it is, another one from there."""
    return normalized(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(parent, F.lit("/"), target)))


def remainder(path: Column, root: Column) -> Column:
    """What follows ``root`` in a path under it, without a slash at its start; null elsewhere."""
    top = F.regexp_replace(root, "/+$", "")
    return F.when(path == top, "").when(F.startswith(path, F.concat(top, F.lit("/"))), F.substring(path, F.length(top) + 2, F.length(path)))


def joined(root: Column, rest: Column) -> Column:
    top = F.regexp_replace(root, "/+$", "")
    return F.when(rest == "", F.when(top == "", "/").otherwise(top)).otherwise(F.concat(top, F.lit("/"), F.regexp_replace(rest, "^/+", "")))


def with_tokens(raw: str, tokens: Mapping[str, str | None]) -> str:
    """A configured path with its leading ``:name:`` replaced; a token elsewhere, or without a value, is an error."""
    name = next((n for n in tokens if raw.startswith(f":{n}:")), None)
    rest = raw if name is None else raw[len(name) + 2 :]
    for other in tokens:
        if f":{other}:" in rest:
            raise ValueError(f"token :{other}: may only begin a path")
    if name is not None and tokens[name] is None:
        raise ValueError(f"token :{name}: has no value yet")
    path = ((tokens[name] or "") + rest if name is not None else raw).rstrip("/")
    if not path.startswith("/") or "\0" in path or any(p in (".", "..") for p in path.split("/")):
        raise ValueError(f"not an absolute, plain path: {raw}")
    return path
