"""Files of a tree as rows, and what manifests, documents, rule files and transcripts say.

A file set is (path, content). All readers are projections or one pass of pandas batches over it: no shuffle but where rows are
made unique.
"""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import ancestors, extension, language, line_count, normal_path

EXCLUDED = ("/.git/", "/node_modules/", "/target/", "/vendor/", "/__pycache__/")
DEPENDENCY = "path string, name string, version string, kind string"
BACKTICK = r"`([^`\s]+\.[A-Za-z0-9]+)`"
LINK = r"\[[^\]]*\]\(([^)\s#]+)(?:#[^)]*)?\)"
BARE = r"(?:^|[\s(])((?:[\w.-]+/)+[\w-]+\.[A-Za-z0-9]+)\b"


def tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SRC8: (path, size_bytes, content) of files under root, paths from root on; excluded folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    p = F.regexp_replace("path", r"^file:/+", "/")
    cut = F.regexp_replace(p, "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.removeprefix("file:").rstrip("/")) + "/", "")
    out = raw.select(cut.alias("path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))
    for x in EXCLUDED:
        out = out.filter(~F.contains(F.concat(F.lit("/"), "path"), F.lit(x)))
    return out


def ingest(files: DataFrame) -> DataFrame:
    """SRC9: a row a file: hash, language, size, lines, the modules above it, and what of it is indexed."""
    p = F.col("path")
    return files.select("path", F.xxhash64("content").alias("content_hash"), language(p).alias("language"), F.octet_length("content").alias("size_bytes"), line_count(F.col("content")).alias("lines"), ancestors(p).alias("modules"))


def _npm(text: str) -> list[tuple]:
    m = json.loads(text)
    return [(n, str(v), k) for key, k in (("dependencies", "normal"), ("devDependencies", "dev")) for n, v in (m.get(key) or {}).items()]


def _cargo(text: str) -> list[tuple]:
    m = tomllib.loads(text)
    out = []
    for table, kind in ((m, None), (m.get("workspace", {}), "workspace")):
        for key, k in (("dependencies", "normal"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
            for n, v in (table.get(key) or {}).items():
                out.append((n, v if isinstance(v, str) else str(v.get("version", "*")) if isinstance(v, dict) else "*", kind or k))
    return out


def _pyproject(text: str) -> list[tuple]:
    import re

    out = []
    for d in tomllib.loads(text).get("project", {}).get("dependencies", []):
        m = re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(.*)", d)
        if m:
            out.append((m[1], m[2].split(";")[0].strip() or "*", "normal"))
    return out


def _gomod(text: str) -> list[tuple]:
    import re

    out = [(m[1], m[2], "normal") for m in re.finditer(r"(?m)^require\s+(\S+)\s+(v\S+)", text)]
    for block in re.findall(r"(?ms)^require\s*\((.*?)^\)", text):
        out += [(m[1], m[2], "normal") for m in re.finditer(r"(?m)^\s*(\S+)\s+(v\S+)", block)]
    return out


MANIFESTS = {"Cargo.toml": _cargo, "package.json": _npm, "pyproject.toml": _pyproject, "go.mod": _gomod}


def dependencies(files: DataFrame) -> DataFrame:
    """SRC10-13: (path, name, version, kind) of every manifest; one that can't be read gives a row of kind 'error'."""

    def run(it):
        for b in it:
            rows = []
            for path, text in zip(b["path"], b["content"]):
                read = MANIFESTS[path.rsplit("/", 1)[-1]]
                try:
                    rows += [(path, *r) for r in read(text or "")]
                except (ValueError, AttributeError, TypeError) as x:
                    rows.append((path, None, str(x)[:200], "error"))
            yield pd.DataFrame(rows, columns=["path", "name", "version", "kind"])

    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(name.isin(*MANIFESTS)).select("path", "content").mapInPandas(run, DEPENDENCY)


def ci_commands(files: DataFrame) -> DataFrame:
    """SRC14, R1: (path, command): `run:` lines of workflows, targets of Makefiles, scripts of package.json; once each, over two
    characters and no lone block mark."""
    line = files.select("path", F.explode(F.split("content", "\n")).alias("line"))
    ci = line.filter(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]*\.ya?ml$|\.gitlab-ci\.yml$")).select("path", F.trim(F.regexp_extract("line", r"^\s*-?\s*run:\s*(.+)$", 1)).alias("command"))
    mk = line.filter(F.col("path").rlike(r"(^|/)Makefile$")).select("path", F.regexp_extract("line", r"^([A-Za-z0-9_.-]+)\s*:(?!=)", 1).alias("t")).filter("t != '' AND NOT startswith(t, '.')").select("path", F.concat(F.lit("make "), "t").alias("command"))
    js = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.explode(F.map_keys(F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>"))).alias("s")).select("path", F.concat(F.lit("npm run "), "s").alias("command"))
    return ci.unionByName(mk).unionByName(js).filter("length(command) > 2").distinct()


def document_type(path: Column) -> Column:
    n = F.lower(path)
    return (
        F.when(n.rlike(r"(^|/)readme"), "Readme").when(n.rlike(r"(^|/)contributing"), "Contributing").when(n.rlike(r"(^|/)architecture"), "Architecture").when(n.rlike(r"(^|/)(adr|decisions?)/"), "Adr")
        .when(n.rlike(r"(^|/)changelog"), "Changelog").when(n.rlike(r"(^|/)(api)"), "ApiDoc").when(n.rlike(r"(^|/)(guides?|tutorials?)/"), "Guide").when(n.rlike(r"(^|/)runbooks?"), "Runbook").otherwise("Other")
    )


def documents(files: DataFrame) -> DataFrame:
    """SRC17: Markdown: title (its first '# ' line, else the file's name), sections of second and third level, words, type."""
    md = files.filter(extension(F.col("path")).isin("md", "mdx", "rst", "txt"))
    lines = F.split("content", "\n")
    heads = F.filter(lines, lambda x: x.rlike(r"^#\s"))
    title = F.coalesce(F.regexp_replace(F.try_element_at(heads, F.lit(1)), r"^#\s+", ""), F.element_at(F.split("path", "/"), -1))
    sections = F.transform(F.filter(lines, lambda x: x.rlike(r"^#{2,3}\s")), lambda x: F.trim(F.regexp_replace(x, r"^#+\s+", "")))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return md.select("path", F.trim(title).alias("title"), sections.alias("sections"), words.alias("word_count"), document_type(F.col("path")).alias("doc_type"), F.contains("content", F.lit(":preserve")).alias("has_preserved"))


def references(files: DataFrame) -> DataFrame:
    """SRC18: (path, target, confidence): links 0.95, names in backticks 0.85, bare paths 0.7; of a target's mentions the first kind
    that has it. Web links are left out."""
    found = F.array(*[F.struct(F.lit(c).alias("confidence"), F.transform(F.regexp_extract_all("content", F.lit(rx), F.lit(1)), lambda x: normal_path(x)).alias("targets")) for c, rx in ((0.95, LINK), (0.85, BACKTICK), (0.7, BARE))])
    x = files.select("path", F.explode(found).alias("f")).select("path", "f.confidence", F.explode("f.targets").alias("target")).filter(~F.col("target").rlike(r"^[a-z]+:"))
    return x.groupBy("path", "target").agg(F.max("confidence").alias("confidence"))


RULES = {"CLAUDE.md": "claude", "AGENTS.md": "agents", ".cursorrules": "cursor", ".windsurfrules": "windsurf", ".clinerules": "cline", "copilot-instructions.md": "copilot"}


def agent_rules(files: DataFrame) -> DataFrame:
    """SRC19: rule files with where they come from and the paths that they name in backticks, sorted, once each."""
    label = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.element_at(F.split("path", "/"), -1)]
    label = F.coalesce(label, F.when(F.col("path").rlike(r"(^|/)\.cursor/rules/"), "cursor"))
    r = files.withColumn("source", label).filter("source IS NOT NULL")
    return r.select("path", "source", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(BACKTICK), F.lit(1)), lambda x: normal_path(x)))).alias("referenced_files"))


SESSION = "role string, timestamp string, content string"
MODIFYING = ("Edit", "Write", "MultiEdit", "NotebookEdit", "edit_file", "write_file", "create_file")
PART = "array<struct<type:string,name:string,text:string,input:struct<file_path:string,path:string>>>"


def session_turns(lines: DataFrame) -> DataFrame:
    """SRC20: lines (session, pos, value: a line of JSON) as turns: role, text, files read or named by tools, files modified, tool
    uses. A line that isn't JSON is left out."""
    j = lines.withColumn("j", F.from_json("value", SESSION)).filter("j.role IS NOT NULL")
    parts = F.from_json(F.when(F.col("j.content").startswith("["), F.col("j.content")), PART)
    t = j.select("session", "pos", F.col("j.role").alias("role"), F.try_to_timestamp(F.col("j.timestamp")).alias("ts"), F.col("j.content").alias("raw"), parts.alias("parts"))
    uses = F.filter(F.coalesce("parts", F.array().cast(PART)), lambda p: p["type"] == "tool_use")
    file = lambda p: normal_path(F.coalesce(p["input"]["file_path"], p["input"]["path"]))
    named = F.array_distinct(F.filter(F.transform(uses, file), lambda x: x.isNotNull()))
    wrote = F.array_distinct(F.filter(F.transform(F.filter(uses, lambda p: p["name"].isin(*MODIFYING)), file), lambda x: x.isNotNull()))
    text = F.coalesce(F.array_join(F.transform(F.filter("parts", lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"), "raw")
    return t.select("session", "pos", "role", "ts", text.alias("text"), named.alias("referenced"), wrote.alias("modified"), F.size(uses).alias("tool_uses"))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts in JSON lines: the session is the file's name, pos a line's place in its file (by the reader's order)."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^/.]*$", 1).alias("session"), F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return session_turns(raw)


def config(path: str) -> dict:
    """SRC29: a TOML configuration over the defaults; depth sets what is read unless it is told."""
    base = {"analysis": {"depth": "standard"}, "extraction": {"max_commits": 2000}, "snapshots": {"every": 0}}
    with open(path, "rb") as f:
        got = tomllib.load(f)
    out = {k: {**base.get(k, {}), **v} if isinstance(v, dict) else v for k, v in {**base, **got}.items()}
    depth = {"shallow": 500, "standard": 2000, "deep": 0, "full": 0}
    if "max_commits" not in got.get("extraction", {}):
        out["extraction"]["max_commits"] = depth.get(out["analysis"].get("depth"), 2000)
    return out
