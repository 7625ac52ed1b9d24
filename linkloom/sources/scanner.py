"""A syntactic scanner for TypeScript and JavaScript declarations.

It knows tokens, brackets, strings, templates, comments and the shapes of declarations, not the whole grammar: what it
does not recognise it passes over, a bracket group at a time. Regular-expression literals are told from divisions by
the token before them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>/\*[\s\S]*?\*/|//[^\n]*)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<word>[#A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|[^\s\w])"
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "in", "of", "=>", "void", "delete", "throw", "new", ""}
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "override", "readonly", "accessor"}
_TYPE_NAME = re.compile(r"\b[A-Z][A-Za-z0-9_]*\b")


@dataclass
class Symbol:
    kind: str
    name: str
    qualified: str
    start: int
    end: int
    signature: str = ""
    documentation: str = ""
    source: str = ""
    exported: bool = False
    parameter_types: list[str] = field(default_factory=list)
    return_type: str = ""


def collapse(text: str, limit: int | None = None) -> str:
    flat = " ".join(text.split())
    return flat if limit is None or len(flat) <= limit else flat[:limit] + "…"


def comment_text(comments: list[str]) -> str:
    """Comments without their marks, one below the other."""
    out = []
    for comment in comments:
        body = re.sub(r"\*/$", "", re.sub(r"^/\*\*?", "", comment))
        lines = [re.sub(r"^//\s?", "", re.sub(r"^\s*\*\s?", "", line)).rstrip() for line in body.split("\n")]
        if text := "\n".join(lines).strip():
            out.append(text)
    return "\n".join(out)


class Scanner:
    def __init__(self, text: str):
        self.text = text
        self.tokens: list[tuple[str, int, int]] = []  # text, begin, end
        self.comments: list[list[str]] = []  # those before each token
        self._tokenize()
        self.partner = self._match()
        self.lines = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.symbols: list[Symbol] = []
        self.exports = False
        self._statements(0, len(self.tokens))

    def _tokenize(self) -> None:
        text, at, before, held = self.text, 0, "", []
        while at < len(text):
            if text[at] == "`":
                end = self._template(at)
            elif text[at] == "/" and before in _BEFORE_REGEX and not text.startswith(("//", "/*"), at) and (m := _REGEX.match(text, at)):
                end = m.end()
            else:
                m = _TOKEN.match(text, at)
                end = m.end() if m else at + 1
                if m and m.lastgroup == "space":
                    at = end
                    continue
                if m and m.lastgroup == "comment":
                    held.append(m.group())
                    at = end
                    continue
            before = text[at:end]
            self.tokens.append((before, at, end))
            self.comments.append(held)
            held, at = [], end

    def _template(self, at: int) -> int:
        """The end of the template literal at ``at``, with the expressions inside of it."""
        text, i = self.text, at + 1
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                depth, i = 1, i + 2
                while i < len(text) and depth:
                    if text[i] == "`":
                        i = self._template(i)
                        continue
                    if text[i] in "\"'" and (m := _TOKEN.match(text, i)) and m.lastgroup == "string":
                        i = m.end()
                        continue
                    depth += {"{": 1, "}": -1}.get(text[i], 0)
                    i += 1
            else:
                i += 1
        return len(text)

    def _match(self) -> dict[int, int]:
        partner, open_ = {}, []
        for i, (t, _, _) in enumerate(self.tokens):
            if t in "([{" and len(t) == 1:
                open_.append(i)
            elif t in _CLOSERS and open_ and self.tokens[open_[-1]][0] == _CLOSERS[t]:
                partner[open_.pop()] = i
        return partner

    def _t(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def _line(self, position: int) -> int:
        return bisect_right(self.lines, position)

    def _new_line(self, i: int) -> bool:
        return i < len(self.tokens) and "\n" in self.text[self.tokens[i - 1][2] : self.tokens[i][1]]

    def _past(self, i: int) -> int:
        """The token after the one at ``i`` or after its bracket group."""
        return self.partner.get(i, i) + 1

    def _past_generics(self, i: int) -> int:
        if self._t(i) != "<":
            return i
        depth = 0
        while i < len(self.tokens):
            depth += {"<": 1, ">": -1}.get(self._t(i), 0)
            i = self._past(i)
            if not depth:
                return i
        return i

    def _past_type(self, i: int) -> int:
        """After a type that starts at ``i``: up to a body, an arrow, an initial value or the end of a statement."""
        first, depth = True, 0
        while i < len(self.tokens):
            t = self._t(i)
            if t == "{" and not first and not depth and self._t(i - 1) not in "|&:,<":
                return i
            if not depth and (t in (";", ",", ")", "}", "=") or t == "=>" and self._t(i - 1) != ")"):
                return i
            if t == "=>" and not depth and self._t(i + 1) == "{":
                return i
            depth += {"<": 1, ">": -1}.get(t, 0)
            i, first = self._past(i), False
        return i

    def _past_statement(self, i: int, hi: int) -> int:
        start = i
        while i < hi:
            t = self._t(i)
            if t == ";":
                return i + 1
            grouped = i in self.partner and t == "{"
            i = self._past(i)
            if i > start and i < hi and self._new_line(i) and (grouped or self._t(i) not in ".?:=>|&+-*/%,)") and self._t(i - 1) not in ("=", "=>", ",", "+", "-", "|", "&", "?", ":", "("):
                return i
        return hi

    def _slice(self, a: int, b: int) -> str:
        """The text from token ``a`` to before token ``b``."""
        return self.text[self.tokens[a][1] : self.tokens[b - 1][2]] if b > a else ""

    def _add(self, kind: str, name: str, qualified: str, first: int, last: int, doc_at: int, signature: str, exported: bool, parameters: list[str] | None = None, returns: str = "", source_from: int | None = None) -> None:
        begin = self.tokens[first if source_from is None else source_from][1]
        end = self.tokens[last - 1][2]
        self.symbols.append(Symbol(kind, name, qualified, self._line(begin), self._line(end - 1), signature, comment_text(self.comments[doc_at]), collapse(self.text[begin:end], 4000), exported, parameters or [], returns))

    def _parameters(self, open_: int) -> tuple[str, list[str]]:
        """The list of parameters as text, and the texts of their types."""
        parts, types, begin, i, close = [], [], open_ + 1, open_ + 1, self.partner.get(open_, open_ + 1)
        depth = 0
        while i <= close:
            t = self._t(i)
            if (t == "," and not depth) or i == close:
                if i > begin:
                    parts.append(collapse(self._slice(begin, i)))
                    colon = next((j for j in self._flat(begin, i) if self._t(j) == ":"), None)
                    if colon is not None:
                        end = next((j for j in self._flat(colon + 1, i) if self._t(j) == "="), i)
                        types.append(collapse(self._slice(colon + 1, end)))
                begin = i + 1
            depth += {"<": 1, ">": -1}.get(t, 0)
            i = self._past(i)
        return ", ".join(parts), types

    def _flat(self, a: int, b: int):
        while a < b:
            yield a
            a = self._past(a)

    def _statements(self, i: int, hi: int) -> None:
        while i < hi:
            first, words = i, set()
            while self._t(i) == "@":  # decorators
                i += 2
                while self._t(i) in (".", "("):
                    i = self._past(i) if self._t(i) == "(" else i + 2
            while self._t(i) in _MODIFIERS and i < hi:
                words.add(self._t(i))
                i += 1
            t, exported = self._t(i), "export" in words
            if exported and (t in ("{", "*", "=", "type", "enum", "import") or "default" in words and t not in ("class", "function")):
                self.exports = self.exports or t in ("{", "*", "=") or "default" in words
                i = self._past_statement(i, hi)
            elif t == "class" and re.match(r"[\w$]", self._t(i + 1)) and self._t(i + 1) != "extends":
                i = self._class(first, i, exported)
            elif t == "interface" and re.match(r"[\w$]", self._t(i + 1)):
                i = self._interface(first, i, exported)
            elif t == "function":
                i = self._function(first, i, exported, words, hi)
            elif t in ("const", "let", "var"):
                i = self._variables(first, i, exported, hi)
            else:
                i = self._past_statement(max(i, first), hi)
            i = max(i, first + 1)

    def _heritage(self, i: int) -> tuple[int, str]:
        body = i
        while body < len(self.tokens) and self._t(body) != "{":
            body = self._past(body)
        after = self._past_generics(i)
        return body, collapse(self._slice(after, body))

    def _class(self, first: int, i: int, exported: bool) -> int:
        name = self._t(i + 1)
        body, heritage = self._heritage(i + 2)
        end = self._past(body)
        self.exports = self.exports or exported
        self._add("class", name, name, first, end, first, f"class {name} {heritage}".strip(), exported)
        self._members(name, body + 1, end - 1)
        return end

    def _interface(self, first: int, i: int, exported: bool) -> int:
        name = self._t(i + 1)
        body, heritage = self._heritage(i + 2)
        end = self._past(body)
        self.exports = self.exports or exported
        self._add("interface", name, name, first, end, first, f"interface {name} {heritage}".strip(), exported)
        return end

    def _function(self, first: int, i: int, exported: bool, words: set[str], hi: int) -> int:
        i += 1 + (self._t(i + 1) == "*")
        name = self._t(i)
        open_ = self._past_generics(i + 1)
        if self._t(open_) != "(" or name == "(":
            return self._past_statement(i, hi)
        end, parameters, types, returns, has_body = self._callable(open_)
        if not has_body:
            return self._past_statement(end, hi)
        self.exports = self.exports or exported
        prefix = "async " if "async" in words else ""
        self._add("function", name, name, first, end, first, f"{prefix}function {name}({parameters})" + (f": {returns}" if returns else ""), exported, types, returns)
        return end

    def _callable(self, open_: int) -> tuple[int, str, list[str], str, bool]:
        """After the body, parameters, their types, the return type, and whether there is a body."""
        parameters, types = self._parameters(open_)
        i, returns = self._past(open_), ""
        if self._t(i) == ":":
            end = self._past_type(i + 1)
            returns, i = collapse(self._slice(i + 1, end)), end
        return (self._past(i), parameters, types, returns, True) if self._t(i) == "{" else (i, parameters, types, returns, False)

    def _variables(self, first: int, i: int, exported: bool, hi: int) -> int:
        i += 1
        while i < hi:
            start, name = i, self._t(i)
            j = self._past(i)
            if self._t(j) == ":":
                j = self._past_type(j + 1)
            if self._t(j) != "=":
                return self._past_statement(i, hi)
            j += 1
            is_async = self._t(j) == "async" and self._t(j + 1) != "=>"
            j += is_async
            k = self._past_generics(j)
            end = None
            if self._t(j) == "function":
                k = j + 1 + (self._t(j + 1) == "*")
                k = self._past_generics(k + (self._t(k) not in ("(", "<")))
                if self._t(k) == "(":
                    end, parameters, types, returns, _ = self._callable(k)
            elif self._t(k) == "(" or self._t(k + 1) == "=>":
                parameters, types = self._parameters(k) if self._t(k) == "(" else (self._t(k), [])
                arrow, returns = self._past(k), ""
                if self._t(arrow) == ":":
                    stop = self._past_type(arrow + 1)
                    returns, arrow = collapse(self._slice(arrow + 1, stop)), stop
                if self._t(arrow) == "=>":
                    end = self._past(arrow + 1) if self._t(arrow + 1) == "{" else self._expression(arrow + 1, hi)
            if end is not None and re.match(r"[\w$]+$", name):
                self.exports = self.exports or exported
                prefix = "async " if is_async else ""
                self._add("function", name, name, first, end, first, f"{prefix}function {name}({parameters})" + (f": {returns}" if returns else ""), exported, types, returns, source_from=start)
            else:
                end = self._expression(j, hi)
            if self._t(end) != ",":
                return end + (self._t(end) == ";")
            i = end + 1
        return hi

    def _expression(self, i: int, hi: int) -> int:
        """The token after an expression: a comma, a semicolon, or the start of a statement on a new line."""
        start = i
        while i < hi:
            if self._t(i) in (",", ";"):
                return i
            if i > start and self._new_line(i) and self._t(i)[0] not in ".?:|&+-*/%=<>" and self._t(i - 1) not in ("=", "=>", "+", "-", "|", "&", "?", ":", "*"):
                return i
            i = self._past(i)
        return hi

    def _members(self, owner: str, i: int, hi: int) -> None:
        while i < hi:
            first, words = i, set()
            while self._t(i) == "@":
                i += 2
                while self._t(i) in (".", "("):
                    i = self._past(i) if self._t(i) == "(" else i + 2
            while self._t(i) in _MODIFIERS and self._t(i + 1) not in ("(", "=", ":", ";", "<", "?", "!"):
                words.add(self._t(i))
                i += 1
            if self._t(i) in ("get", "set") and self._t(i + 1) not in ("(", "=", ":", ";", "<", "?"):
                i += 1
            i += self._t(i) == "*"
            name = self._slice(i, self._past(i)) if i < hi else ""
            open_ = self._past_generics(self._past(i) + (self._t(self._past(i)) == "?"))
            if self._t(open_) == "(" and name not in ("", ";", "{", "}"):
                end, parameters, types, returns, has_body = self._callable(open_)
                if has_body:
                    prefix = ("static " if "static" in words else "") + ("async " if "async" in words else "")
                    if name == "constructor":
                        if parameters or comment_text(self.comments[first]):
                            self._add("constructor", name, f"{owner}.{name}", first, end, first, f"{prefix}constructor({parameters})", False, types, returns)
                    else:
                        self._add("method", name, f"{owner}.{name}", first, end, first, f"{prefix}{name}({parameters})" + (f": {returns}" if returns else ""), False, types, returns)
                    i = end
                else:
                    i = end + (self._t(end) == ";")
            else:
                i = self._past_statement(i, hi)
            i = max(i, first + 1)


def scan(path: str, text: str) -> tuple[list[Symbol], set[str]]:
    """All symbols of a file, interfaces included, and the type names that parameters and return types mention."""
    scanner = Scanner(text)
    last = text.count("\n") + 1
    head = comment_text(scanner.comments[0]) if scanner.tokens else ""
    stem = re.sub(r"\.(tsx|ts|jsx|js)$", "", path)
    body = text[scanner.tokens[0][1] :] if scanner.tokens else ""
    out = [Symbol("file", path.split("/")[-1], path, 1, last, "", head, collapse(body, 4000), scanner.exports)]
    if scanner.exports:
        out.append(Symbol("module", stem.split("/")[-1], stem, 1, last, "", head, "", True))
    named = {n for s in scanner.symbols for t in (*s.parameter_types, s.return_type) for n in _TYPE_NAME.findall(t)}
    return [*out, *scanner.symbols], named
