"""Symbols, imports and calls of one source file. Python is parsed; for other
languages declarations are found line by line (a brace may stand on the next line)
and scopes by brace, indent or end."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cache

from ..functions.code import STOP_WORDS
from .languages import BARE, IMPORTS, SYNTAX

BODY_LINES, BODY_CHARS = 200, 2000
_CALL = re.compile(r"\b([A-Za-z_]\w+)\s*\(")
_STOP = set(STOP_WORDS)


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    signature: str | None = None
    body: str = ""


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    #: (place of the enclosing symbol or -1, callee, line)
    calls: list[tuple[int, str, int]] = field(default_factory=list)


#: What precedes a method without a body, in languages that declare it with its type.
_NO_TYPE = "return|new|throw|await|yield|else|case|goto|using|import|package"


@cache
def _declarations(language: str) -> list[tuple[str, re.Pattern]]:
    _, before, words = SYNTAX[language]
    lead = rf"^(\s*)(?:(?:{'|'.join(before.split())})\s+)*" if before else r"^(\s*)"
    out = [(kind, re.compile(rf"{lead}(?:{word})\s+(?:self\.)?([A-Za-z_]\w+[?!]?)\s*(\([^)]*\))?")) for kind, word in words.items()]
    if language == "go":
        out.insert(0, ("interface", re.compile(r"^(\s*)(?:type\s+)?([A-Za-z_]\w+)\s+interface\s*\{()")))
        out.insert(0, ("method", re.compile(r"^(\s*)func\s*\([^)]*\)\s*([A-Za-z_]\w+)\s*(\([^)]*\))?")))
    if language in ("typescript", "javascript"):
        out.append(("function", re.compile(r"^(\s*)(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::\s*[^=]+)?=>|\w+\s*=>)()")))
    if language in BARE:
        kind = "function" if language in ("c", "cpp") else "method"
        out.append((kind, re.compile(r"^(\s*)(?:[\w:<>,*&\[\]]+\s+)*?[*&]*(?:\w+::)?([A-Za-z_]\w+)\s*(\([^;{}]*\))[^;{}=]*\{\s*[^{}]*\}?\s*$")))
    if language in ("java", "csharp"):
        out.append(("method", re.compile(rf"^(\s*)(?!\s*(?:{_NO_TYPE})\b)(?:[\w<>\[\],.?]+\s+)+([A-Za-z_]\w+)\s*(\([^;{{}}()=]*\))\s*(?:throws\s+[\w., ]+)?;\s*$")))
    return out


@cache
def _words(language: str) -> frozenset[str]:
    """Words of declarations, which are no calls. In interfaces there are only signatures."""
    _, before, words = SYNTAX[language]
    return frozenset(before.split()) | {x for w in words.values() for x in w.split("|")}


def _strip(lines: list[str], language: str) -> list[str]:
    """The lines without comments: whole-line ones, and blocks from a line that begins one."""
    mark = "#" if language in ("python", "ruby") else "//"
    out, inside = [], False
    for line in lines:
        s = line.strip()
        if inside:
            inside = "*/" not in s
            out.append("")
        elif mark == "//" and s.startswith("/*"):
            inside = "*/" not in s
            out.append("")
        else:
            out.append("" if s.startswith(mark) else line)
    return out


def _braces(lines: list[str]) -> tuple[list[int], list[int]]:
    """(lines of opening braces in order, lines of those that close them); both from 0."""
    opens, closes, stack = [], [], []
    for k, line in enumerate(lines):
        for ch in line:
            if ch == "{":
                stack.append(len(opens))
                opens.append(k)
                closes.append(len(lines) - 1)
            elif ch == "}" and stack:
                closes[stack.pop()] = k
    return opens, closes


def _end(lines: list[str], at: int, how: str, braces: tuple[list[int], list[int]]) -> int:
    """The last line of the scope that begins on line ``at`` (from 0); as a number from 1."""
    if how == "brace":
        i = bisect_left(braces[0], at)
        if i == len(braces[0]):
            return at + 1
        depth = 0
        for k in range(at, braces[0][i]):  # a scope opens on the declaration's last line or on the next
            depth += lines[k].count("(") - lines[k].count(")")
            following = lines[k + 1].strip()
            if lines[k].rstrip().endswith(";") or depth <= 0 and following and not following.startswith("{"):
                return k + 1
        return braces[1][i] + 1
    indent, last = len(lines[at]) - len(lines[at].lstrip()), at
    for k in range(at + 1, len(lines)):
        if lines[k].strip():
            here = len(lines[k]) - len(lines[k].lstrip())
            if here <= indent:
                return k + 1 if how == "end" and lines[k].strip().startswith("end") else last + 1
            last = k
    return last + 1


def _with_bodies(found: Parsed, lines: list[str]) -> Parsed:
    for s in found.symbols:
        s.body = "\n".join(lines[s.start_line - 1 : min(s.end_line, s.start_line + BODY_LINES) - 1])[:BODY_CHARS]
    found.imports = list(dict.fromkeys(found.imports))
    return found


def _owners(symbols: list[Symbol], n: int) -> list[int]:
    """Of each line, from 1, the innermost symbol around it, or -1."""
    order = sorted(range(len(symbols)), key=lambda i: (symbols[i].start_line, -symbols[i].end_line, i))
    out, stack, j = [-1] * (n + 1), [], 0
    for line in range(1, n + 1):
        while stack and symbols[stack[-1]].end_line < line:
            stack.pop()
        while j < len(order) and symbols[order[j]].start_line == line:
            stack.append(order[j])
            j += 1
        out[line] = next((i for i in reversed(stack) if symbols[i].end_line >= line), -1)
    return out


#: Languages whose functions in a class are methods, and what makes a class there.
_METHODS_IN = {"python": ("class",), "ruby": ("class", "module"), "php": ("class", "interface"), "cpp": ("class",), "rust": ()}
_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b")


def extract_lines(content: str, language: str) -> Parsed:
    how = SYNTAX[language][0]
    raw = content.split("\n")
    lines = _strip(raw, language)
    braces = _braces(lines) if how == "brace" else ([], [])
    out = Parsed()
    imports = re.compile(IMPORTS[language])
    defined: set[tuple[str, int]] = set()
    within = -1  # the last line of the class or block whose functions are methods
    following = [""] * (len(lines) + 1)  # of each line the next that is not empty
    for k in range(len(lines) - 1, 0, -1):
        following[k - 1] = lines[k].strip() or following[k]
    for k, line in enumerate(lines):
        if m := imports.search(line):
            out.imports.append(next(g for g in m.groups() if g))
        if language == "rust" and _IMPL.match(line):
            within = max(within, _end(lines, k, how, braces) - 1)
        whole = line.rstrip() + " {" if language in BARE and "(" in line and "{" not in line and following[k].startswith("{") else line
        for kind, rx in _declarations(language):
            m = rx.match(whole)
            if m and m[2] not in _STOP and not (m[2] == "constructor" and language in ("typescript", "javascript")):
                end = _end(lines, k, how, braces)
                if kind == "function" and language in _METHODS_IN and k <= within:
                    kind = "method"
                out.symbols.append(Symbol(m[2], kind, k + 1, end, f"{m[2]}{m[3]}" if m[3] else None))
                if kind in _METHODS_IN.get(language, ()):
                    within = max(within, end - 1)
                defined.add((m[2], k + 1))
                break
    owner, words = _owners(out.symbols, len(lines)), _words(language) | {"constructor"}
    for k, line in enumerate(lines):
        for m in _CALL.finditer(line):
            signature = owner[k + 1] >= 0 and out.symbols[owner[k + 1]].kind == "interface" and language != "rust"
            if m[1] not in _STOP and m[1] not in words and (m[1], k + 1) not in defined and not signature:
                out.calls.append((owner[k + 1], m[1], k + 1))
    return _with_bodies(out, raw)


class _Walk(ast.NodeVisitor):
    def __init__(self) -> None:
        self.out, self.scope, self.classes = Parsed(), [-1], [False]

    def _define(self, node: ast.AST, kind: str, signature: str | None, is_class: bool) -> None:
        self.out.symbols.append(Symbol(node.name, kind, node.lineno, node.end_lineno, signature))
        self.scope.append(len(self.out.symbols) - 1)
        self.classes.append(is_class)
        self.generic_visit(node)
        self.scope.pop()
        self.classes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._define(node, "method" if self.classes[-1] else "function", f"{node.name}({ast.unparse(node.args)})", False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._define(node, "class", None, True)

    def visit_Import(self, node: ast.Import) -> None:
        self.out.imports += [a.name for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self.out.imports.append("." * node.level + (node.module or ""))

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
        if len(name) > 1 and name not in _STOP:
            self.out.calls.append((self.scope[-1], name, node.lineno))
        self.generic_visit(node)


def extract(content: str, language: str) -> Parsed:
    """Nothing for an empty file; Python that does not parse is read line by line."""
    if language == "python":
        try:
            walk = _Walk()
            walk.visit(ast.parse(content))
            return _with_bodies(walk.out, content.split("\n"))
        except (SyntaxError, ValueError, RecursionError):
            pass
    return extract_lines(content, language if language in SYNTAX else "generic")
