"""Column expressions on source code: complexity, maintainability, roles, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decision points and nesting words by language. The word boundaries
# around operators are part of the definition.
CYCLOMATIC = {
    "javascript": r"\b(if|else\s+if|while|for|switch|case|catch|&&|\|\||\?)\b",
    "typescript": r"\b(if|else\s+if|while|for|switch|case|catch|&&|\|\||\?)\b",
    "python": r"\b(if|elif|while|for|except|and|or)\b",
    "go": r"\b(if|else\s+if|for|switch|case|select|&&|\|\|)\b",
    "rust": r"\b(if|else\s+if|while|for|match|&&|\|\||\?)\b",
    "java": r"\b(if|else\s+if|while|for|switch|case|catch|&&|\|\|)\b",
    "csharp": r"\b(if|else\s+if|while|for|foreach|switch|case|catch|&&|\|\|)\b",
    "cpp": r"\b(if|else\s+if|while|for|switch|case|catch|&&|\|\|)\b",
    "c": r"\b(if|else\s+if|while|for|switch|case|&&|\|\|)\b",
    "php": r"\b(if|elseif|while|for|foreach|switch|case|catch|&&|\|\|)\b",
    "ruby": r"\b(if|elsif|unless|while|for|until|case|when|rescue|&&|\|\|)\b",
    "generic": r"\b(if|while|for|switch|case|&&|\|\|)\b",
}
NESTING = {
    "javascript": "if else while for switch try catch",
    "typescript": "if else while for switch try catch",
    "python": "if elif else while for try except with",
    "go": "if else for switch select",
    "rust": "if else while for match loop",
    "java": "if else while for switch try catch",
    "csharp": "if else while for foreach switch try catch",
    "cpp": "if else while for switch try catch",
    "c": "if else while for switch",
    "php": "if elseif else while for foreach switch try catch",
    "ruby": "if elsif else unless while for until begin rescue",
    "generic": "if else while for",
}
UNNESTING = {"python": "else elif except finally", "ruby": "end"}
CAP = 100


def _blank(body: Column) -> Column:
    return body.isNull() | ~body.rlike(r"\S")


def cyclomatic(body: Column, language: str = "generic") -> Column:
    """1 + decision points, at most 100; a blank body has 1."""
    rx = CYCLOMATIC.get(language, CYCLOMATIC["generic"])
    return F.when(_blank(body), 1).otherwise(F.least(F.regexp_count(body, F.lit(rx)) + 1, F.lit(CAP)))


def _decisions(language: str) -> list[str]:
    """The words and operators of a language's decision points, as texts."""
    inner = CYCLOMATIC[language].removeprefix(r"\b(").removesuffix(r")\b")
    return [w.replace("\\", "") for w in inner.replace(r"\|\|", "\0").split("|") for w in [w.replace("\0", "||")] if r"\s" not in w]


def decision_points(body: Column) -> Column:
    """Everything in the body that is a decision point in some language, found in one
    pass. A whole word or an operator between words is matched alone, so a language's
    points are those of these that it has; ``else if`` counts by its ``if``."""
    every = sorted({w for language in CYCLOMATIC for w in _decisions(language)})
    return F.regexp_extract_all(body, F.lit(r"\b(" + "|".join(re.escape(w) for w in every) + r")\b"), F.lit(0))


def cyclomatic_of(points: Column, language: str) -> Column:
    """``cyclomatic`` by the body's ``decision_points``."""
    return F.least(F.coalesce(F.size(F.filter(points, lambda w: w.isin(_decisions(language)))), F.lit(0)) + 1, F.lit(CAP))


def _any_word(words: str) -> str:
    return r"\b(" + "|".join(words.split()) + r")\b"


def code_lines(body: Column) -> Column:
    """The body's lines, trimmed, without empty ones and whole-line comments."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#"))


def _operators(lines: Column) -> Column:
    text = F.array_join(lines, "\n")
    return F.regexp_count(text, F.lit("&&")) + F.regexp_count(text, F.lit(r"\|\|"))


def cognitive(body: Column, language: str = "generic", lines: Column | None = None) -> Column:
    """Nesting-weighted complexity, at most 100. Only languages with words that end
    a level ever leave one; for the others the fold has a closed form. ``lines``: the
    body's ``code_lines``, where several languages share them."""
    words = "|".join(NESTING.get(language, NESTING["generic"]).split())
    lines = code_lines(body) if lines is None else lines
    if language not in UNNESTING:
        # each line at most once: the expression begins where a line does
        n = F.regexp_count(F.array_join(lines, "\n"), F.lit(rf"(?dm)^[^\n]*?\b({words})\b")).cast("long")
        total = F.expr("0L") + n * (n + 1) / 2 + _operators(lines)
    else:
        grow, shrink = rf"\b({words})\b", _any_word(UNNESTING[language])
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("nest"))

        def step(a: Column, x: Column) -> Column:
            up = x.rlike(grow)
            nest = a["nest"] + up.cast("int")
            down = x.rlike(shrink) | x.isin("}", "end")
            left = F.when(down, F.greatest(nest - 1, F.lit(0))).otherwise(nest)
            return F.struct((a["total"] + F.when(up, 1 + a["nest"]).otherwise(0)).alias("total"), left.alias("nest"))

        total = F.aggregate(lines, start, step)["total"] + _operators(lines)
    return F.when(_blank(body), 0).otherwise(F.least(total.cast("long"), F.lit(CAP)).cast("int"))


def nesting_marks(lines: Column, languages: list[str]) -> Column:
    """For each of the ``code_lines`` with a nesting word of some language a number
    whose bit k says that language k has one of its words: one pass over the words."""
    masks = {w: sum(1 << k for k, x in enumerate(languages) if w in NESTING[x].split()) for w in sorted({w for x in languages for w in NESTING[x].split()})}
    rx = _any_word(" ".join(masks))
    of_word = F.create_map(*[F.lit(x) for pair in masks.items() for x in pair])
    found = lambda line: F.regexp_extract_all(line, F.lit(rx), F.lit(0))
    return F.transform(F.filter(lines, lambda x: x.rlike(rx)), lambda x: F.aggregate(found(x), F.lit(0), lambda m, w: m.bitwiseOR(F.element_at(of_word, w))))


def operators(lines: Column) -> Column:
    return _operators(lines)


def cognitive_of(body: Column, marks: Column, ops: Column, k: int) -> Column:
    """``cognitive`` of the k-th language of ``nesting_marks``, one that leaves no level."""
    n = F.size(F.filter(marks, lambda m: m.bitwiseAND(F.lit(1 << k)) != 0)).cast("long")
    return F.when(_blank(body), 0).otherwise(F.least((n * (n + 1) / 2 + ops).cast("long"), F.lit(CAP)).cast("int"))


def maintainability(cyclomatic_: Column, start_line: Column, end_line: Column) -> Column:
    """171 - 5.2 ln(loc) - 0.23 max(1, cyclomatic) - 16.2 ln(loc), within 0 and 100; 100 without lines."""
    loc = end_line - start_line + 1
    index = 171 - 5.2 * F.ln(loc) - 0.23 * F.greatest(F.lit(1), cyclomatic_) - 16.2 * F.ln(loc)
    return F.when(loc <= 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index)))


# Names and paths of entry points, and words the extractor may take for names.
ENTRY_ROLE_NAMES = "main index run start init bootstrap create build setup"
UTILITY_PREFIXES = "util helper format parse convert transform validate check get set is has to from"
STOP_WORDS = "if else for while do switch case return break continue try catch finally new delete typeof void throw yield await super this in of from as".split()
ENTRY_NAMES = "(?i:^(main|handler|index|start|run|bootstrap|init|listen|serve|launch|setup|createServer|createApp|makeApp)$)|Handler$|Controller$|Router$|Routes?$"
ENTRY_FILES = r"/(index|main|app|server|handler|entry|bootstrap|start)\.[tj]sx?$|/cmd/|/cmd\.[tj]sx?$|/bin/"
ENTRY_BODIES = r"app\.(get|post|put|patch|delete|use)\s*\(|router\.(get|post|put|patch|delete|use)\s*\(|fastify\.(get|post|put|patch|delete)\s*\(|server\.(route|inject)\s*\(|express\(\)|@(Get|Post|Put|Patch|Delete|Controller|Route)\s*\("
API_NAMES = "main handler index start run bootstrap init listen serve launch setup createserver createapp makeapp".split()
API_SUFFIXES = ("handler", "controller", "router", "routes")
API_FILES = ("/index.ts", "/index.js", "/main.ts", "/main.js", "/app.ts", "/server.ts")
ROLES = ("entry", "core", "utility", "adapter", "dead", "leaf", "unknown")


def role(name: Column, kind: Column, ind: Column, outd: Column, avg_in: Column, avg_out: Column, exported: Column) -> Column:
    """The first rule that holds decides."""
    most = lambda share, avg, least: F.greatest(F.lit(float(share)) * avg, F.lit(float(least)))
    named = lambda words, end: name.rlike(f"(?i)^({'|'.join(words.split())}){end}")
    return (
        F.when((ind == 0) & ~exported & ~kind.isin("class", "interface", "type"), "dead")
        .when(exported & (ind >= most(1.5, avg_in, 2)), "entry")
        .when(named(ENTRY_ROLE_NAMES, "$"), "entry")
        .when(ind >= most(2, avg_in, 3), "core")
        .when((outd == 0) & (ind > 0), "leaf")
        .when((outd >= most(2, avg_out, 3)) & (ind > 0), "adapter")
        .when((ind <= most(1, avg_in, 1)) & (outd <= most(1, avg_out, 1)) & named(UTILITY_PREFIXES, ""), "utility")
        .otherwise("unknown")
    )


# Path parts that name a module below a front or back end, in order of precedence.
FRONT, BACK = ("frontend", "fe"), ("backend", "be")
FRONT_PARTS = ("store", "core", "shared", "layout")
BACK_PARTS = ("service", "entity", "controller", "repository", "security", "config", "exception", "dto", "sri")
BANDS = ((50, "O"), (26, "B"), (13, "A"), (7, "F"), (4, "G"), (2, "K"), (0, "M"))


def module_key(path: Column) -> Column:
    """The module a file's path belongs to: its first two parts, or by known parts."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    known = lambda prefix, names: [(F.array_contains(parts, n), F.lit(f"{prefix}·{n}")) for n in names]
    or_root = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("root"))

    def chain(rules: list[tuple[Column, Column]], last: Column) -> Column:
        for cond, value in reversed(rules):
            last = F.when(cond, value).otherwise(last)
        return last

    feature = F.nullif(F.get(parts, F.array_position(parts, "features").cast("int")), F.lit(""))
    has_feature = F.array_contains(parts, "features") & feature.isNotNull()
    front = chain([(has_feature, F.concat(F.lit("fe·"), feature)), *known("fe", FRONT_PARTS)], F.concat(F.lit("fe·"), or_root(F.get(parts, F.lit(1)))))
    back = chain(known("be", BACK_PARTS), F.concat(F.lit("be·"), or_root(F.get(parts, F.size(parts) - 2))))
    top = parts[0]
    return F.when(top.isin(*FRONT), front).when(top.isin(*BACK), back).otherwise(or_root(F.array_join(F.slice(parts, 1, 2), "/")))


def band(connections: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for least, letter in reversed(BANDS[:-1]):
        out = F.when(connections >= least, letter).otherwise(out)
    return out
