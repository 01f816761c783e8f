"""Definitions, calls and imports of source files in 13 languages by their tokens.

A scanner takes comments and strings out, finds definitions by each language's keywords, closes them by braces, by `end` or by
indentation, and takes names before '(' for calls. It knows no grammar, hence confidences under 1. parse() is one pass of
pandas batches over (path, content).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import LANGUAGES

ROWS = "path string, what string, name string, qualified string, kind string, start int, `end` int, owner string, target string, confidence double, doc string"


@dataclass
class Language:
    defs: list[tuple[str, str]]  # expression with the name in its group, kind
    imports: list[str]
    line: str = "//"
    block: tuple[str, str] | None = ("/*", "*/")
    body: str = "braces"  # braces, indent, end
    doc: str = "///"
    sep: str = "::"
    call: float = 0.7
    imported: float = 0.9
    quotes: str = "\"'`"
    extra: frozenset = field(default_factory=frozenset)


N = r"([A-Za-z_$][\w$]*)"
JS = [(rf"\bfunction\s*\*?\s+{N}", "Function"), (rf"\bclass\s+{N}", "Type"), (rf"\b(?:const|let|var)\s+{N}\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)", "Function"), (rf"^\s+(?:static\s+|async\s+|public\s+|private\s+|protected\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){N}\s*\([^)]*\)\s*(?::[^{{=]+)?\{{", "Function")]
JS_IMPORTS = [r"""\bimport\s+(?:[^'";]*?\bfrom\s+)?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)"""]
RULES: dict[str, Language] = {
    "rust": Language([(rf"\bfn\s+{N}", "Function"), (rf"\b(?:struct|enum|trait|union|type)\s+{N}", "Type"), (rf"\bmod\s+{N}\s*\{{", "Module"), (rf"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?{N}", "Scope")], [r"\buse\s+([\w:]+)"], quotes='"', imported=0.8),
    "python": Language([(rf"^\s*(?:async\s+)?def\s+{N}", "Function"), (rf"^\s*class\s+{N}", "Type")], [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"], line="#", block=None, body="indent", doc="#", sep="."),
    "javascript": Language(JS, JS_IMPORTS, doc="/**", sep="."),
    "typescript": Language([*JS, (rf"\b(?:interface|enum|type)\s+{N}", "Type")], JS_IMPORTS, doc="/**", sep="."),
    "go": Language([(rf"^func\s+(?:\([^)]*\)\s*)?{N}", "Function"), (rf"^type\s+{N}", "Type")], [r"""^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$"""], doc="//", sep="."),
    "java": Language([(rf"\b(?:class|interface|enum|record)\s+{N}", "Type"), (rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ?]+\s+{N}\s*\([^;{{]*\)\s*(?:throws\s+[\w, .]+)?\{{", "Function")], [r"^\s*import\s+(?:static\s+)?([\w.]+)"], doc="/**", sep="."),
    "kotlin": Language([(rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?{N}", "Function"), (rf"\b(?:class|interface|object)\s+{N}", "Type")], [r"^\s*import\s+([\w.]+)"], doc="/**", sep="."),
    "ruby": Language([(rf"^\s*def\s+(?:self\.)?({N[1:-1]}[?!=]?)", "Function"), (rf"^\s*class\s+{N}", "Type"), (rf"^\s*module\s+{N}", "Module")], [r"""^\s*require(?:_relative)?\s*\(?['"]([^'"]+)['"]"""], line="#", block=None, body="end", doc="#"),
    "swift": Language([(rf"\bfunc\s+{N}", "Function"), (rf"\b(?:class|struct|enum|protocol|extension)\s+{N}", "Type")], [r"^\s*import\s+([\w.]+)"], quotes='"', sep="."),
    "csharp": Language([(rf"\b(?:class|interface|struct|enum|record)\s+{N}", "Type"), (rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed)\s+)*[\w<>\[\], ?]+\s+{N}\s*\([^;{{]*\)\s*\{{?$", "Function")], [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"], sep="."),
    "php": Language([(rf"\bfunction\s+&?{N}", "Function"), (rf"\b(?:class|interface|trait|enum)\s+{N}", "Type")], [r"^\s*use\s+([\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]"""], doc="/**"),
    "zig": Language([(rf"\bfn\s+{N}", "Function"), (rf"\bconst\s+{N}\s*=\s*(?:packed\s+|extern\s+)?(?:struct|enum|union)\b", "Type")], [r"""@import\(\s*"([^"]+)"\s*\)"""], quotes='"', sep="."),
    "lean": Language([(r"^\s*(?:private\s+|protected\s+|noncomputable\s+|partial\s+)*(?:def|theorem|lemma|abbrev|instance)\s+([\w.'!?]+)", "Function"), (r"^\s*(?:structure|inductive|class)\s+([\w.']+)", "Type")], [r"^\s*import\s+([\w.]+)"], line="--", block=("/-", "-/"), body="indent", doc="/--", sep=".", call=0.6, quotes='"'),
}
WORDS = frozenset("if for while switch match return catch fn func function def class new sizeof typeof await assert print not and or in is elif else with lambda yield raise super using foreach unless until when case guard defer do try".split())
CALL = re.compile(r"([A-Za-z_][\w]*)\s*(!?)\(")


def blank(text: str, lang: Language) -> str:
    """text with comments and strings as blanks, line ends kept. Imports are looked for before that."""
    parts = [re.escape(lang.line) + r"[^\n]*"]
    if lang.block:
        parts.insert(0, re.escape(lang.block[0]) + r".*?(?:" + re.escape(lang.block[1]) + r"|\Z)")
    if lang.body == "indent" and lang.line == "#":
        parts[:0] = [r'"""(?:[^\\]|\\.)*?(?:"""|\Z)', r"'''(?:[^\\]|\\.)*?(?:'''|\Z)"]
    for q in lang.quotes:
        # a quote that opens a character or string; a string of one line, but for backticks
        parts.append(q + (r"(?:[^`\\]|\\.)*" if q == "`" else rf"(?:[^{q}\\\n]|\\.)*") + q)
    rx = re.compile("|".join(parts), re.S)
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def ends(clean: list[str], starts: list[int], lang: Language) -> list[int]:
    """The last line of each definition that begins in these lines."""
    out, begins = [], set(starts)
    if lang.body == "braces":
        depth, d = [0], 0
        first = []  # depth before each line
        for line in clean:
            first.append(d)
            d += line.count("{") - line.count("}")
            depth.append(d)
        for s in starts:
            e, opened = s, False
            for k in range(s, len(clean)):
                if "{" in clean[k]:
                    opened = True
                if opened and depth[k + 1] <= first[s]:
                    e = k
                    break
                if not opened and ";" in clean[k]:
                    e = k
                    break
                e = k
                if not opened and k + 1 in begins:  # no body before the next definition
                    e = s
                    break
            out.append(e)
        return out
    width = [len(x) - len(x.lstrip()) if x.strip() else None for x in clean]
    for s in starts:
        e = s
        for k in range(s + 1, len(clean)):
            if width[k] is None:
                continue
            if width[k] <= width[s]:
                if lang.body == "end" and clean[k].strip().startswith("end") and width[k] == width[s]:
                    e = k
                break
            e = k
        out.append(e)
    return out


def doc_above(lines: list[str], at: int, lang: Language) -> str | None:
    """The comment right above a definition, attributes passed over, its marks taken off."""
    k, got = at - 1, []
    while k >= 0 and re.match(r"^\s*[@#]\[?\w", lines[k]) and lang.line != "#":
        k -= 1
    if lang.block and k >= 0 and lines[k].rstrip().endswith(lang.block[1]):
        while k >= 0:
            got.append(lines[k])
            if lang.block[0] in lines[k]:
                break
            k -= 1
    else:
        while k >= 0 and lines[k].strip().startswith(lang.line):
            got.append(lines[k])
            k -= 1
    text = "\n".join(re.sub(r"^\s*(?:/\*\*?|/-+|\*/|-/|\*|//[/!]?|#+|--+)\s?|\s*(?:\*/|-/)\s*$", "", x).rstrip() for x in reversed(got)).strip()
    return text or None


def docstring(lines: list[str], at: int) -> str | None:
    """A Python definition's docstring: what is quoted right below its head, which ends with a colon outside brackets."""
    depth = 0
    for k in range(at, len(lines)):
        line = re.sub(r"\s*#.*$", "", lines[k])
        if k > at and re.match(r"\s*(?:async\s+def|def|class)\b", line):
            return None
        depth += sum(map(line.count, "([{")) - sum(map(line.count, ")]}"))
        if depth > 0:
            continue
        if not line.rstrip().endswith(":"):
            return None
        k += 1
        while k < len(lines) and not lines[k].strip():
            k += 1
        m = re.match(r"""\s*[rRuU]?(\"\"\"|''')(.*)$""", lines[k]) if k < len(lines) else None
        if not m:
            return None
        got = [m[2]]
        while m[1] not in got[-1]:
            k += 1
            if k == len(lines):
                return None
            got.append(lines[k])
        return " ".join("\n".join(got).split(m[1])[0].split()) or None
    return None


def parse_file(path: str, text: str) -> list[tuple]:
    """Rows of ROWS for one file: what is 'def', 'call' or 'import'. Lines are counted from 1."""
    name = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    lang = RULES.get(name)
    if lang is None or not text:
        return []
    out = []
    lines = text.split("\n")
    for rx in lang.imports:
        for m in re.finditer(rx, text, re.M):
            at = text.count("\n", 0, m.start(1)) + 1
            out.append((path, "import", m[1].split("::")[-1] if name == "rust" else m[1], None, None, at, at, None, m[1], lang.imported, None))
    clean = blank(text, lang).split("\n")
    found: dict[int, tuple[str, str]] = {}
    for rx, kind in lang.defs:
        c = re.compile(rx)
        for k, line in enumerate(clean):
            if k not in found and (m := c.search(line)) and m[1] not in WORDS:
                found[k] = (m[1], kind)
    starts = sorted(found)
    last = ends(clean, starts, lang)
    spans = [(s, e, *found[s]) for s, e in zip(starts, last)]
    open_: list[tuple] = []
    functions = []
    for s, e, n, kind in spans:
        while open_ and open_[-1][1] < s:
            open_.pop()
        q = lang.sep.join([x[2] for x in open_] + [n])
        open_.append((s, e, n))
        if kind == "Scope":
            continue
        doc = docstring(lines, s) if name == "python" else doc_above(lines, s, lang)
        out.append((path, "def", n, q, kind, s + 1, e + 1, None, None, None, doc))
        if kind == "Function":
            functions.append((s, e, q))
    def_lines = {(k, n) for k, (n, _) in found.items()}
    for k, line in enumerate(clean):
        for m in CALL.finditer(line):
            if m[1] in WORDS or (k, m[1]) in def_lines:
                continue
            inside = [f for f in functions if f[0] <= k <= f[1]]
            if inside:
                own = min(inside, key=lambda f: f[1] - f[0])
                out.append((path, "call", m[1], None, None, k + 1, k + 1, own[2], m[1], lang.call - 0.1 if m[2] else lang.call, None))
    return out


def parse(files: DataFrame) -> DataFrame:
    """A row a definition, call (within a function) and import of (path, content). Files of other languages give none."""

    def run(it):
        for b in it:
            rows = [r for p, t in zip(b["path"], b["content"]) for r in parse_file(p, t)]
            yield pd.DataFrame(rows, columns=["path", "what", "name", "qualified", "kind", "start", "end", "owner", "target", "confidence", "doc"])

    return files.filter("path IS NOT NULL AND content IS NOT NULL").select("path", "content").mapInPandas(run, ROWS)


def definitions(parsed: DataFrame) -> DataFrame:
    """GR20: entities as they are stored: 'path::qualified', a Module as a Type."""
    d = parsed.filter("what = 'def'")
    return d.select(F.when(F.col("kind") == "Function", "Function").otherwise("Type").alias("kind"), F.concat("path", F.lit("::"), "qualified").alias("name"), "path", "start", "end", "doc")


def call_edges(parsed: DataFrame) -> DataFrame:
    """GR15, GR18: (caller, callee, confidence): a call's name among its own file's definitions, at the call's confidence; else, if
    exactly one file that this one imports defines it, 1.0."""
    d = parsed.filter("what = 'def' AND kind != 'Scope'").select("path", "name", F.concat("path", F.lit("::"), "qualified").alias("callee")).groupBy("path", "name").agg(F.min("callee").alias("callee"))
    c = parsed.filter("what = 'call'").select("path", "name", F.concat("path", F.lit("::"), "owner").alias("caller"), "confidence")
    own = c.join(d, ["path", "name"], "left")
    here = own.filter("callee IS NOT NULL").groupBy("caller", "callee").agg(F.max("confidence").alias("confidence"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    imp = parsed.filter("what = 'import'").select("path", F.explode(F.split("target", r"::|/|\.|\\")).alias("stem")).distinct()
    far = own.filter("callee IS NULL").select("path", "name", "caller").distinct().join(imp, "path").join(d.select(stem.alias("stem"), "name", "callee"), ["stem", "name"])
    far = far.groupBy("caller", "name").agg(F.count_distinct("callee").alias("n"), F.min("callee").alias("callee")).filter("n = 1").select("caller", "callee", F.lit(1.0).alias("confidence"))
    return here.unionByName(far)
