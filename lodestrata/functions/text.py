"""Names, paths and texts as column expressions; pandas UDFs where no built-in will do."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "rb": "ruby", "swift": "swift", "cs": "csharp", "php": "php", "zig": "zig", "lean": "lean", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp",
    "md": "markdown", "toml": "toml", "json": "json", "yaml": "yaml", "yml": "yaml", "sh": "shell", "sql": "sql", "html": "html", "css": "css",
}
SOURCE = ("rust", "python", "typescript", "javascript", "go", "java", "kotlin", "ruby", "swift", "csharp", "php", "zig", "lean", "c", "cpp")


def leaf_name(x: Column) -> Column:
    """What follows the last '::'."""
    return F.element_at(F.split(x, "::"), -1)


def name_style(x: Column) -> Column:
    """snake_case, SCREAMING_SNAKE_CASE, PascalCase, camelCase, lowercase, mixed or unknown, tried in this order. With an
    underscore the case of all letters tells it, without one the first letter does."""
    under = F.contains(x, F.lit("_"))
    return (
        F.when(x.isNull() | (x == ""), "unknown")
        .when(under & (x == F.lower(x)), "snake_case")
        .when(under & (x == F.upper(x)), "SCREAMING_SNAKE_CASE")
        .when(~under & x.rlike(r"^\p{Lu}"), "PascalCase")
        .when(~under & x.rlike(r"^\p{Ll}") & x.rlike(r"\p{Lu}"), "camelCase")
        .when(~under & (x == F.lower(x)), "lowercase")
        .otherwise("mixed")
    )


def directory(path: Column) -> Column:
    """All before the last slash; nothing where there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def dir_of(path: Column) -> Column:
    """directory(), with '.' where there is no slash."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(directory(path))


def ancestors(path: Column) -> Column:
    """SRC9: every directory above a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    e = extension(path)
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[e]


#: Ends of source files' names.
SOURCE_ENDS = r"\.(cs|go|java|js|jsx|kt|kts|lean|php|py|rb|rs|swift|ts|tsx|zig)$"


def is_test_file(path: Column) -> Column:
    """By the customs of names and folders, for salience: one of three predicates of tests."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    return name.rlike(r"^test_|_test\.(rs|py|go)$|\.(test|spec)\.(ts|js|tsx)$|tests?\.java$") | path.rlike(r"(^|/)(tests|test|__tests__)/")


def has_test_mark(path: Column) -> Column:
    """By marks anywhere in a path, for the testing pattern (so contest_x.py counts)."""
    return path.rlike(r"/tests?/|_test\.|test_|\.test\.|\.spec\.|_spec\.")


def mentions_test(path: Column) -> Column:
    """By the words alone, for the risk map."""
    return F.lower(path).rlike("test|spec")


def source_of_test(path: Column) -> Column:
    """The file that a test is for, by its name, in the same folder; null where the name doesn't say."""
    name, folder = F.regexp_extract(path, r"([^/]*)$", 1), directory(path)
    base = (
        F.when(name.endswith("_test.rs"), F.regexp_replace(name, r"_test(\.rs)$", "$1"))
        .when(name.startswith("test_"), F.substring(name, 6, 1 << 30))
        .when(name.rlike(r"_test\.(py|go)$"), F.regexp_replace(name, r"_test(\.[a-z]+)$", "$1"))
        .when(name.rlike(r"\.(test|spec)\.(ts|js|tsx)$"), F.regexp_replace(name, r"\.(?:test|spec)(\.[a-z]+)$", "$1"))
    )
    return F.when(folder == "", base).otherwise(F.concat(folder, F.lit("/"), base))


def normal_path(path: Column) -> Column:
    """'./' off the front; of an absolute path what begins at 'src/', else its last three parts."""
    p = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(~p.startswith("/"), p).when(F.instr(p, "/src/") > 0, F.concat(F.lit("src/"), F.substring_index(p, "/src/", -1))).otherwise(F.substring_index(p, "/", -3))


def occurrences(text: Column, literal: str) -> Column:
    """How often a literal occurs, not overlapping."""
    return (F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal) if literal else F.lit(0)


def word_count(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def good_comment(text: Column) -> Column:
    """At least 20 bytes that aren't a stand-in."""
    t = F.trim(text)
    return (F.octet_length(t) >= 20) & ~F.lower(t).rlike(r"^(todo|fixme|xxx|tbd|hack|placeholder)\b")


def identifier(text: Column) -> Column:
    """Letters, digits and underscores; what begins with a digit gets an underscore in front."""
    t = F.regexp_replace(text, r"[^A-Za-z0-9_]+", "_")
    return F.when(t.rlike(r"^[0-9]"), F.concat(F.lit("_"), t)).otherwise(t)


def common_prefix(paths: list[str]) -> str:
    """Whole path parts that all paths begin with."""
    parts = [p.split("/")[:-1] for p in paths]
    out = []
    for level in zip(*parts):
        if len(set(level)) > 1:
            break
        out.append(level[0])
    return "/".join(out)


@F.pandas_udf(LongType())
def fnv1a64(x: pd.Series) -> pd.Series:
    """FNV-1a of UTF-8, its 64 bits as a signed number."""

    def one(s):
        if s is None:
            return None
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return h - (1 << 64) if h >> 63 else h

    return x.map(one).astype("Int64")


def byte_prefix(n: int):
    """The longest beginning of a text of n bytes at most that ends between characters."""

    @F.pandas_udf(StringType())
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else s.encode()[:n].decode(errors="ignore"))

    return cut


def line_count(content: Column) -> Column:
    """SRC5: lines of a text, a last one without its end included; 0 for what has a NUL in its first 8192 characters."""
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.instr(F.substring(content, 1, 8192), "\0") > 0, 0).when(content == "", 0).otherwise(n + F.when(content.endswith("\n"), 0).otherwise(1))


def issue_refs(text: Column, strict: bool = True) -> Column:
    """SRC27: numbers after a closing word. strict: the word stands alone and '#' follows it; else any '#' after the word's letters."""
    rx = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?):?\s+#(\d+)" if strict else r"(?is)(?:clos|fix|resolv)[^#]*#(\d+)"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda x: x.cast("long")))


def remote_of(url: Column) -> Column:
    """SRC30: (host, owner, repo) of a forge's remote."""
    rx = r"^(?:https?://|ssh://git@|git@)([^/:]+)[:/](.+?)/([^/]+?)(?:\.git)?/?$"
    return F.struct(*[F.regexp_extract(url, rx, i).alias(n) for i, n in ((1, "host"), (2, "owner"), (3, "repo"))])
