"""Languages by file extension, and what the extractor looks for in each."""

from __future__ import annotations

import re
from functools import cache

# Extensions by language, of binary files, and of files to index.
LANGUAGES = {
    "typescript": ".ts .tsx .mts .cts",
    "javascript": ".js .jsx .mjs .cjs",
    "python": ".py .pyw .pyi",
    "go": ".go",
    "rust": ".rs",
    "java": ".java",
    "csharp": ".cs",
    "cpp": ".cpp .cc .cxx .c++ .hpp .hxx .h++",
    "c": ".c .h",
    "php": ".php .phtml",
    "ruby": ".rb .rake",
}
BINARY = ".png .jpg .jpeg .gif .bmp .ico .svg .mp3 .mp4 .wav .avi .mov .zip .tar .gz .rar .7z .pdf .doc .docx .xls .xlsx .exe .dll .so .dylib .a .lib .ttf .woff .woff2 .eot .db .sqlite .sqlite3 .lock .bin .dat".split()
OTHERS = ".vue .svelte .json .yaml .yml .toml .md .txt .rst .sh .bash .zsh .fish .sql".split()
BY_EXTENSION = {e: lang for lang, exts in LANGUAGES.items() for e in exts.split()}
INDEXABLE = [*BY_EXTENSION, *OTHERS]
IGNORED = "node_modules/** .git/** dist/** build/** out/** .next/** .nuxt/** coverage/** __pycache__/** *.pyc .DS_Store Thumbs.db *.min.js *.min.css *.map vendor/** .venv/** venv/** env/** target/** bin/** obj/** *.lock package-lock.json yarn.lock pnpm-lock.yaml".split()

#: Of each language: words that may precede a declaration, and declaration words by
#: kind. "brace" languages end a scope with a brace, "indent" with a smaller indent,
#: "end" with the word end at the same indent.
SYNTAX = {
    "typescript": ("brace", "export default declare abstract async const public private protected static readonly", {"class": "class", "interface": "interface", "type": "type", "enum": "enum", "function": "function", "module": "namespace"}),
    "javascript": ("brace", "export default async static", {"class": "class", "function": "function"}),
    "python": ("indent", "async", {"class": "class", "function": "def"}),
    "go": ("brace", "", {"function": "func", "type": "type"}),
    "rust": ("brace", "pub async unsafe const extern", {"class": "struct", "interface": "trait", "enum": "enum", "type": "type", "function": "fn", "module": "mod"}),
    "java": ("brace", "public private protected abstract final static sealed", {"class": "class", "interface": "interface", "enum": "enum"}),
    "csharp": ("brace", "public private protected internal abstract sealed static partial", {"class": "class", "interface": "interface", "enum": "enum"}),
    "cpp": ("brace", "inline static virtual typedef", {"class": "class|struct", "enum": "enum", "module": "namespace"}),
    "c": ("brace", "static inline extern typedef", {"class": "struct", "enum": "enum"}),
    "php": ("brace", "abstract final public private protected static", {"class": "class|trait", "interface": "interface", "function": "function"}),
    "ruby": ("end", "", {"class": "class", "module": "module", "function": "def"}),
    "generic": ("brace", "export public private static async", {"class": "class|struct|interface", "function": "function|func|def|fn"}),
}
#: Languages whose methods and functions have no word of their own.
BARE = {"typescript", "javascript", "java", "csharp", "cpp", "c"}
IMPORTS = {
    "typescript": r"""(?:^\s*import\b.*?['"]|\bfrom\s+['"]|\brequire\s*\(\s*['"])([^'"]+)['"]""",
    "python": r"^\s*(?:from|import)\s+([\w.]+)",
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$',
    "rust": r"^\s*(?:pub\s+)?(?:use|extern\s+crate)\s+([\w:]+)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "csharp": r"^\s*using\s+([\w.]+)\s*;",
    "cpp": r'^\s*#\s*include\s+[<"]([^>"]+)[>"]',
    "php": r"""^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+))""",
    "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)""",
    "generic": r"""^\s*(?:import|require|include|use)\s+['"]?([^'"\s;]+)""",
}
IMPORTS |= {"javascript": IMPORTS["typescript"], "c": IMPORTS["cpp"]}


@cache
def ignore_pattern(globs: tuple[str, ...] = tuple(IGNORED)) -> str:
    """One expression for paths that ignore rules exclude: a name matches at any
    depth, ``dir/**`` all below, a leading slash binds to the root."""
    out = []
    for g in globs:
        g = g.strip()
        if not g or g[0] in "#!":
            continue
        rooted = g.startswith("/")
        g = g.strip("/").removesuffix("/**")
        body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|\*|\?|[^*?]+", g))
        out.append(("^" if rooted else "(?:^|/)") + body + "(?:/|$)")
    return "|".join(out) or "(?!)"


def gitignore_rules(text: str) -> list[tuple[bool, bool, str]]:
    """(takes back, folders only, expression of whole paths) of each line, in order."""
    out = []
    for line in text.splitlines():
        g = re.sub(r"(?<!\\)\s+$", "", line)
        if not g or g[0] == "#":
            continue
        back = g[0] == "!"
        g = g[back:]
        folder = g.endswith("/")
        g = g.rstrip("/")
        bound = "/" in g
        g = g.removeprefix("/")
        if not g:
            continue
        body = ""
        for x in re.findall(r"^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]/]*\]|\\.|.", g):
            if x == "**/":
                body += "(?:.*/)?"
            elif x == "/**/":
                body += "/(?:.*/)?"
            elif x == "/**":
                body += "/.+"
            elif x[0] == "*":
                body += "[^/]*"
            elif x == "?":
                body += "[^/]"
            elif x[0] == "[" and len(x) > 1:
                negated = x[1] in "!^"
                inner = x[1 + negated : -1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
                body += f"[{'^/' if negated else ''}{inner}]"
            else:
                body += re.escape(x[-1])
        out.append((back, folder, "(?i)^" + ("" if bound else "(?:.*/)?") + body + "$"))
    return out
