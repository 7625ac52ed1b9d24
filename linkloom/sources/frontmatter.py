"""YAML mappings of frontmatter and configuration files."""

from __future__ import annotations

import re

try:
    import yaml
except ImportError:  # the reader below covers scalars, lists and lists of flat mappings
    yaml = None

_PAIR = re.compile(r"^(\s*)([\w.-]+|\"[^\"]+\"|'[^']+'):(?:\s+(.*?))?\s*$")


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\s*(\"[^\"]*\"|'[^']*'|[^,\[\]]+)", text[1:-1]) if x.strip()]
    if text in ("", "~", "null"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    """The value that starts at line ``at`` with at least ``indent`` blanks; and the line after it."""
    if at >= len(lines) or lines[at][0] < indent:
        return None, at
    own, text = lines[at]
    if text == "-" or text.startswith("- "):
        items = []
        while at < len(lines) and lines[at][0] == own and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
            rest = lines[at][1][1:].strip()
            if _PAIR.match(rest):
                inner = [(own + 2, rest)]
                at += 1
                while at < len(lines) and lines[at][0] > own:
                    inner.append(lines[at])
                    at += 1
                items.append(_block(inner, 0, 0)[0])
            else:
                items.append(_scalar(rest))
                at += 1
        return items, at
    found = {}
    while at < len(lines) and lines[at][0] == own:
        pair = _PAIR.match(lines[at][1])
        if not pair:
            raise ValueError(f"not a mapping: {lines[at][1]}")
        key = _scalar(pair[2])
        if pair[3]:
            found[key], at = _scalar(pair[3]), at + 1
        else:
            nested = at + 1 < len(lines) and (lines[at + 1][0] > own or lines[at + 1][0] == own and lines[at + 1][1].startswith("-"))
            found[key], at = _block(lines, at + 1, own) if nested else (None, at + 1)
    return found, at


def read_mapping(text: str):
    """The YAML value of ``text``; ValueError where it is none."""
    if yaml is not None:
        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as error:
            raise ValueError(str(error)) from error
    lines = [(len(line) - len(line.lstrip()), line.strip()) for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    value, at = _block(lines, 0, 0)
    if at < len(lines):
        raise ValueError(f"cannot read: {lines[at][1]}")
    return value
