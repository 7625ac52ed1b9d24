"""Which paths of a source tree are indexed: fixed directories, minified and generated files, gitignore patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold no sources of one's own, and marks of generated files.
DIRECTORIES = (".git", "node_modules", "dist", "build", "out", ".next", ".nuxt", "coverage", ".nyc_output", "vendor", "third_party", "generated")
GENERATED = r"(?i)@generated|do not edit|automatically generated|auto-generated"
MINIFIED = r"(?i)\.min\.[cm]?[jt]sx?$"
SOURCES = r"(?i)\.(ts|tsx|js|jsx)$"
DECLARATIONS = r"(?i)\.d\.[cm]?ts$"


def gitignore_regex(pattern: str) -> str | None:
    """A regular expression over POSIX paths for one gitignore pattern (without ``!``), None for blanks and comments."""
    text = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not text or text.startswith("#"):
        return None
    text = text[1:] if text.startswith("\\") else text
    folder = text.endswith("/")
    text = text.rstrip("/")
    anchored = "/" in text
    text = text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and (end := text.find("]", i + 2)) > 0:
            body = text[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif text[i] == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(text[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last matching pattern excludes ``path``; ``!`` takes a path back unless its folder is excluded."""
    out: Column = F.lit(False)
    for pattern in patterns:
        back = pattern.startswith("!")
        compiled = gitignore_regex(pattern[1:] if back else pattern)
        if compiled:
            out = F.when(path.rlike(compiled), F.lit(not back)).otherwise(out)
    return out


def excluded_path(path: Column, patterns: list[str] | None = None, directories: tuple[str, ...] = DIRECTORIES) -> Column:
    """Whether any folder on the way is excluded, the file is minified, or a pattern says so. Null counts as not."""
    clean = F.translate(path, "\\", "/")
    parts = F.split(clean, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    hit = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in directories])) | clean.rlike(MINIFIED)
    return F.coalesce(hit | ignored(clean, patterns or []), F.lit(False))


def is_source(path: Column) -> Column:
    return path.rlike(SOURCES) & ~path.rlike(DECLARATIONS)


def is_generated(content: Column, sample: int = 500) -> Column:
    """Whether the head of a file says that it is generated."""
    return F.coalesce(F.substring(content, 1, sample).rlike(GENERATED), F.lit(False))
