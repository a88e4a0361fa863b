"""A plain scanner of Java declarations, file by file: what tests hold the columns of ``sources.java`` against."""

from __future__ import annotations

import re
_TOKEN = re.compile(
    r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|[^\W\d][\w$]*|\d[\w.]*|\.\.\.|->|::|@interface\b|\S',
    re.DOTALL,
)
_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed"}
_TYPES = {"class", "interface", "enum", "record", "@interface"}
_CLOSE = {"(": ")", "{": "}", "[": "]"}


class ParseError(ValueError):
    pass


class _Scanner:
    def __init__(self, text: str) -> None:
        self.tokens = [t for t in _TOKEN.findall(text) if not t.startswith(("//", "/*"))]
        self.match: dict[int, int] = {}
        open_: list[int] = []
        for i, t in enumerate(self.tokens):
            if t in _CLOSE:
                open_.append(i)
            elif t in ")}]":
                if not open_ or _CLOSE[self.tokens[open_[-1]]] != t:
                    raise ParseError(f"unbalanced {t}")
                self.match[open_.pop()] = i
        if open_:
            raise ParseError(f"unclosed {self.tokens[open_[-1]]}")
        self.package, self.imports, self.first = "", [], None
        self.fields, self.constructors, self.parameters = [], [], []

    def at(self, i: int) -> str:
        return self.tokens[i] if i < len(self.tokens) else ""

    def name(self, i: int) -> tuple[str, int]:
        """A dotted name at i, and what follows it."""
        parts = [self.at(i)]
        while self.at(i + 1) == "." and re.match(r"[^\W\d]|\*", self.at(i + 2)):
            parts.append(self.at(i + 2))
            i += 2
        return ".".join(parts), i + 1

    def annotations(self, i: int) -> tuple[list[str], int]:
        """Annotations and modifiers at i."""
        found = []
        while True:
            if self.at(i) == "@" and self.at(i + 1) != "interface":
                name, i = self.name(i + 1)
                found.append(name)
                if self.at(i) == "(":
                    i = self.match[i] + 1
            elif self.at(i) in _MODIFIERS and self.at(i + 1) not in ("=", ";", ",", ".", "("):
                i += 1
            elif self.at(i) == "non" and self.at(i + 1) == "-":
                i += 3
            else:
                return found, i

    def generic(self, i: int) -> int:
        """The place after the ``<...>`` at i."""
        depth = 0
        while True:
            i = self.match[i] if self.at(i) == "(" else i
            depth += {"<": 1, ">": -1}.get(self.at(i), 0)
            if self.at(i) in ("", ";", "{"):
                raise ParseError("unclosed <")
            i += 1
            if not depth:
                return i

    def without_notes(self, i: int, end: int) -> list[str]:
        out = []
        while i < end:
            if self.at(i) == "@":
                _, i = self.name(i + 1)
                i = self.match[i] + 1 if self.at(i) == "(" else i
                continue
            out.append(self.at(i))
            i += 1
        return out

    def type(self, i: int) -> tuple[str, int] | None:
        """A written type at i without annotations, as it is printed."""
        _, i = self.annotations(i)
        if not re.match(r"[^\W\d]", self.at(i)):
            return None
        out, i = self.name(i)
        while True:
            if self.at(i) == "<":
                end = self.generic(i)
                inner = self.without_notes(i + 1, end - 1)
                text = "".join(", " if t == "," else f" {t} " if t in ("extends", "super", "&") else t for t in inner)
                out, i = f"{out}<{text}>", end
            elif self.at(i) == "[" and self.at(i + 1) == "]":
                out, i = out + "[]", i + 2
            elif self.at(i) == "." and re.match(r"[^\W\d]", self.at(i + 1)):
                more, i = self.name(i + 1)
                out = f"{out}.{more}"
            else:
                return out, i

    def parameter_types(self, i: int) -> list[str]:
        """Types of the parameters in the parentheses at i; of ``T...`` the element type."""
        out, end = [], self.match[i]
        i += 1
        while i < end:
            found = self.type(i)
            if found is None:
                raise ParseError("no parameter type")
            text, i = found
            if self.at(i) == "...":
                i += 1
            receiver = self.at(i) == "this"
            i += 1
            while self.at(i) == "[" and i < end:
                text, i = text + "[]", self.match[i] + 1
            if not receiver:
                out.append(text)
            while i < end and self.at(i) != ",":
                i += 1
            i += 1
        return out

    def unit(self) -> None:
        i = 0
        while i < len(self.tokens):
            start = i
            notes, i = self.annotations(i)
            if self.at(i) == "package":
                self.package, i = self.name(i + 1)
            elif self.at(i) == "import":
                name, i = self.name(i + 1 + (self.at(i + 1) == "static"))
                self.imports.append(name.removesuffix(".*"))
            elif self.declares_type(i):
                i = self.declaration(i, notes)
            elif self.at(i) == ";":
                i += 1
            elif i < len(self.tokens):
                raise ParseError(f"unexpected {self.at(i)}")
            if i == start:
                raise ParseError(f"unexpected {self.at(i)}")

    def declares_type(self, i: int) -> bool:
        if self.at(i) == "@" and self.at(i + 1) == "interface":
            return True
        if self.at(i) == "record":
            return bool(re.match(r"[^\W\d]", self.at(i + 1))) and self.at(i + 2) in ("(", "<")
        return self.at(i) in _TYPES and bool(re.match(r"[^\W\d]", self.at(i + 1)))

    def declaration(self, i: int, notes: list[str]) -> int:
        """The type declaration at its keyword; returns what follows its body."""
        if self.at(i) == "@":
            i += 1
            kind = "@interface"
        else:
            kind = self.at(i)
        own = {"name": self.at(i + 1), "interface": kind == "interface", "annotations": notes, "extends": [], "implements": [], "fields": [], "methods": []}
        if kind in ("class", "interface") and self.first is None:
            self.first = own
        name, i = self.at(i + 1), i + 2
        if self.at(i) == "<":
            i = self.generic(i)
        if self.at(i) == "(":
            i = self.match[i] + 1
        clause = None
        while self.at(i) != "{":
            if self.at(i) in ("extends", "implements", "permits"):
                clause, i = self.at(i), i + 1
            found = self.type(i)
            if found is None:
                raise ParseError(f"no body of {name}")
            if clause in ("extends", "implements"):
                own[clause].append(found[0].partition("<")[0].rpartition(".")[2])
            i = found[1] + (self.at(found[1]) == ",")
        self.body(i, name, kind, own)
        return self.match[i] + 1

    def body(self, i: int, name: str | None, kind: str, own: dict | None) -> None:
        """The members of the type body at i."""
        end = self.match[i]
        i += 1
        if kind == "enum":
            while i < end and self.at(i) != ";":  # constants, some with arguments or bodies
                if self.at(i) == "{":
                    self.body(i, None, "class", None)
                    i = self.match[i]
                elif self.at(i) in "([":
                    self.code(i, self.match[i])
                    i = self.match[i]
                i += 1
        while i < end:
            notes, i = self.annotations(i)
            if self.at(i) in (";", "}"):
                i += 1
            elif self.at(i) == "{":
                self.code(i, self.match[i])
                i = self.match[i] + 1
            elif self.declares_type(i):
                i = self.declaration(i, notes)
            else:
                i = self.member(i, name, own)

    def member(self, i: int, name: str | None, own: dict | None) -> int:
        if self.at(i) == "<":
            i = self.generic(i)
            _, i = self.annotations(i)
        if self.at(i) == name and self.at(i + 1) in ("(", "{"):  # a constructor, or a record's short one
            if self.at(i + 1) == "(":
                self.constructors += self.parameter_types(i + 1)
            return self.rest(i + 1)
        begin, found = i, self.type(i)
        if found is None:
            raise ParseError(f"unexpected {self.at(i)}")
        text, i = found
        if self.at(i + 1) == "(":
            self.parameters += self.parameter_types(i + 1)
            if own:
                own["methods"].append(self.at(i))
            return self.rest(i + 1)
        while True:  # a field's variables
            if not re.match(r"[^\W\d]", self.at(i)):
                raise ParseError(f"unexpected {self.at(i)}")
            one, i = text, i + 1
            while self.at(i) == "[":
                one, i = one + "[]", self.match[i] + 1
            self.fields.append(one)
            if self.at(i) == "=":
                start = i
                angle = 0
                while self.at(i) != ";" and not (self.at(i) == "," and not angle):
                    if not self.at(i):
                        raise ParseError("unclosed field")
                    if self.at(i) in _CLOSE:
                        i = self.match[i]
                    elif self.at(i) == "<" and (self.at(i - 1) == "." or self.at(i - 1)[:1].isupper()):
                        angle += 1
                    elif self.at(i) == ">" and angle:
                        angle -= 1
                    i += 1
                self.code(start, i)
            if self.at(i) == ";":
                if own:
                    own["fields"].append(" ".join(self.tokens[begin:i]) + ";")
                return i + 1
            if self.at(i) != ",":
                raise ParseError(f"unexpected {self.at(i)}")
            i += 1

    def rest(self, i: int) -> int:
        """What follows a method whose parameters or body begin at i."""
        while self.at(i) not in ("{", ";"):
            if not self.at(i):
                raise ParseError("unclosed method")
            i = self.match.get(i, i) + 1
        if self.at(i) == ";":
            return i + 1
        self.code(i, self.match[i])
        return self.match[i] + 1

    def code(self, i: int, end: int) -> None:
        """Local and anonymous classes among statements and expressions."""
        i += 1
        while i < end:
            if self.declares_type(i) and self.at(i - 1) not in (".", "::") and self.at(i) != "@":
                i = self.declaration(i, [])
                continue
            if self.at(i) == "new" and (found := self.type(i + 1)) and self.at(found[1]) == "(":
                close = self.match[found[1]]
                self.code(found[1], close)
                i = close + 1
                if self.at(i) == "{":
                    self.body(i, None, "class", None)
                    i = self.match[i] + 1
                continue
            i += 1


def declarations(text: str) -> dict:
    """Class metadata and written types of one file; raises ParseError."""
    scanner = _Scanner(text)
    try:
        scanner.unit()
    except KeyError as e:
        raise ParseError("unbalanced brackets") from e
    first = scanner.first or {}
    return {
        "class_name": first.get("name"), "package_name": scanner.package, "is_interface": first.get("interface", False),
        "super_class": (first.get("extends") or [None])[-1], "interfaces": first.get("implements", []), "annotations": first.get("annotations", []),
        "imports": scanner.imports if first else [], "fields": first.get("fields", []), "methods": first.get("methods", []),
        "field_types": scanner.fields, "constructor_types": scanner.constructors, "parameter_types": scanner.parameters, "error": None,
    }
