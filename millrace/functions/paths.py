"""File-name functions and glob predicates over path columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions and their MIME types.
IMAGE_MIME_TYPES = {
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
}
UNKNOWN_MIME_TYPE = "application/octet-stream"


def plain_path(uri: Column) -> Column:
    """``file:`` URIs (percent-encoded) as plain paths; other schemes stay as they are."""
    local = F.regexp_replace(uri, "^file:/+", "/")
    decoded = F.try_url_decode(F.replace(local, F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file:"), F.coalesce(decoded, local)).otherwise(uri)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix as ``pathlib`` sees it: ``.hidden`` and ``name.`` have none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def extension(path: Column) -> Column:
    """Extension as ``os.path.splitext`` sees it (leading dots never start one)."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.left(name, F.char_length(name) - F.char_length(extension(path)))


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root`` (X3); a path that is the root itself keeps only its name."""
    prefix = root.rstrip("/") + "/"
    return F.when(
        path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)
    ).otherwise(basename(path))


def mime_type(path: Column) -> Column:
    """MIME type by extension, ignoring case."""
    ext = F.lower(extension(path))
    expr = F.when(ext == "", UNKNOWN_MIME_TYPE)
    for known, mime in IMAGE_MIME_TYPES.items():
        expr = expr.when(ext == known, mime)
    return expr.otherwise(UNKNOWN_MIME_TYPE)


def _component_regex(component: str) -> str:
    out, i = [], 0
    while i < len(component):
        ch = component[i]
        close = component.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif close > 0:
            members = component[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + members[1:] if members[0] == "!" else members) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """A glob over a relative path; ``**/`` spans any number of folders."""
    parts = pattern.strip("/").split("/")
    out = []
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out.append("(?:[^/]+/)*" + ("[^/]+" if last else ""))
        else:
            out.append(_component_regex(part) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def right_anchored_regex(pattern: str) -> str:
    """``PurePath.match``: a relative pattern matches from the right, component by component."""
    body = "/".join(_component_regex(p) for p in pattern.split("/") if p not in ("", "."))
    return f"^/{body}$" if pattern.startswith("/") else f"(?:^|/){body}$"


def expand_braces(pattern: str) -> list[str]:
    """Expand the first ``{a,b}`` group; later groups stay literal."""
    match = re.match(r"^([^{]*)\{([^}]*)\}(.*)$", pattern, re.S)
    if not match:
        return [pattern]
    head, options, tail = match.groups()
    return [f"{head}{option}{tail}" for option in options.split(",")]


def matches_any(path: Column, regexes: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{r})" for r in regexes)) if regexes else F.lit(False)
