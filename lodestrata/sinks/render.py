"""Documents, maps and graphs from results. What a writer takes are top-k results, so that what comes to the
driver is bounded by k; tables of any size are written by Spark (risk_map_json, module_contexts)."""

from __future__ import annotations

import html
import json
import os
import re
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import dir_of

KEEP = re.compile(r"<!-- keep:(?P<id>[\w-]+) -->.*?<!-- /keep:(?P=id) -->", re.S)


def header(commit: str | None, at: datetime | None = None) -> str:
    """SNK14: when and of what a document was made."""
    at = at or datetime.now(timezone.utc)
    return f"<!-- generated at={at.strftime('%Y-%m-%dT%H:%M:%SZ')} commit={commit or 'unknown'} -->\n"


def merged(new: str, old: str | None) -> str:
    """SNK13: new with the blocks kept from old: in place where new has the block too, else at the end."""
    if not old:
        return new
    kept = {m["id"]: m[0] for m in KEEP.finditer(old)}
    out = KEEP.sub(lambda m: kept.pop(m["id"], m[0]), new)
    return out if not kept else out.rstrip("\n") + "\n\n" + "\n\n".join(kept.values()) + "\n"


def write(path: str, text: str, merge: bool = True) -> bool:
    """Writes a document over its former state, by a rename; says whether anything but the header changed."""
    old = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    text = merged(text, old) if merge else text
    body = lambda t: re.sub(r"^<!-- generated .*-->\n", "", t)
    if old is not None and body(old) == body(text):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".new", path)
    return True


def table(rows: Iterable, columns: list[str]) -> str:
    """Rows as a Markdown table."""
    cell = lambda x: ("" if x is None else f"{x:.2f}" if isinstance(x, float) else ", ".join(map(str, x)) if isinstance(x, list) else str(x)).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])


def sections(title: str, parts: dict[str, DataFrame | str], commit: str | None = None, k: int = 20) -> str:
    """SNK7, SNK11: a document with a section for each result, of which the first k rows are shown; empty ones are left out."""
    out = [header(commit) + f"# {title}"]
    for name, part in parts.items():
        if isinstance(part, str):
            body = part
        else:
            rows = part.limit(k).collect()
            body = table(rows, part.columns) if rows else ""
        if body:
            out.append(f"## {name}\n\n{body}")
    return "\n\n".join(out) + "\n"


def report(title: str, parts: dict[str, DataFrame], k: int = 20) -> str:
    """SNK12: the same as a page of HTML."""
    e = lambda x: html.escape("" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x))
    body = []
    for name, df in parts.items():
        rows = df.limit(k).collect()
        head = "".join(f"<th>{e(c)}</th>" for c in df.columns)
        body.append(f"<h2>{e(name)}</h2><table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{e(r[c])}</td>" for c in df.columns) + "</tr>" for r in rows) + "</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{''.join(body)}</body></html>"


def risk_map_json(risks: DataFrame, commit: str | None) -> str:
    """SNK9: all files at risk, the riskiest first, and those that are safe: a row a file of one work tree, brought here part by part."""
    rows = risks.orderBy(F.desc("score"), "file").select("score", "file", F.to_json(F.struct("file", "level", "score", "reasons", "recommendations")).alias("j"))
    areas, safe = [], []
    for r in rows.toLocalIterator():
        if r.score > 0:
            areas.append(json.loads(r.j))
        else:
            safe.append(r.file)
    return json.dumps({"version": 1, "generated_at": datetime.now(timezone.utc).isoformat(), "commit": commit, "risk_areas": areas, "safe_areas": safe}, indent=1)


def module_contexts(entities: DataFrame, files: DataFrame, k: int = 20) -> DataFrame:
    """SNK8, R10: (dir, text): each directory's files and its k entities (path, name, score) of the highest score; made in tasks."""
    f = files.select(dir_of(F.col("path")).alias("dir"), "path").groupBy("dir").agg(F.array_sort(F.collect_list("path")).alias("files"))
    e = entities.filter("score > 0").select(dir_of(F.col("path")).alias("dir"), F.struct((-F.col("score")).alias("s"), "name").alias("e")).groupBy("dir").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("es"))
    names = F.coalesce(F.array_join(F.transform("es", lambda x: F.concat(F.lit("- "), x["name"])), "\n"), F.lit(""))
    paths = F.array_join(F.transform("files", lambda x: F.concat(F.lit("- "), x)), "\n")
    return f.join(e, "dir", "left").select("dir", F.concat(F.lit("# "), "dir", F.lit("\n\n## Files\n\n"), paths, F.lit("\n\n## Entities\n\n"), names, F.lit("\n")).alias("text"))


def skill_documents(skills: DataFrame, k: int = 50) -> dict[str, str]:
    """SNK10: file name -> text of the k commonest skills (files, frequency, kind)."""
    out = {}
    for r in skills.orderBy(F.desc("frequency"), F.col("files").cast("string")).limit(k).collect():
        files = [str(x) for x in r.files]
        name = re.sub(r"[^a-z0-9]+", "-", "-".join(x.rsplit("/", 1)[-1] for x in files[:3]).lower()).strip("-")[:60] or "skill"
        while name in out:
            name += "-2"
        out[name] = f"# Change {', '.join(files[:3])}\n\nSeen {r.frequency} times ({r.kind}).\n\n" + "\n".join(f"- {x}" for x in files) + "\n"
    return out


def ranking(df: DataFrame, how: str = "text", name: str = "name", score: str = "score", k: int = 20) -> str:
    """SNK15: a ranking as text, json or markdown."""
    rows = df.orderBy(F.desc(score), name).limit(k).collect()
    if how == "json":
        return json.dumps([{"rank": i, name: r[name], score: r[score]} for i, r in enumerate(rows, 1)])
    if how == "markdown":
        return table([{"rank": i, name: r[name], score: r[score]} for i, r in enumerate(rows, 1)], ["rank", name, score])
    return "\n".join(f"{i:4d}  {r[score]:.6f}  {r[name]}" for i, r in enumerate(rows, 1))


def graph(edges: DataFrame, how: str = "dot", k: int = 200) -> str:
    """SNK15: the k heaviest edges as dot or mermaid."""
    rows = edges.orderBy(F.desc("weight"), "src", "dst").limit(k).collect()
    q = lambda x: json.dumps(str(x), ensure_ascii=False)
    if how == "dot":
        return "digraph g {\n" + "".join(f"  {q(r.src)} -> {q(r.dst)} [weight={r.weight:g}];\n" for r in rows) + "}\n"
    number = {x: f"n{i}" for i, x in enumerate(dict.fromkeys(x for r in rows for x in (r.src, r.dst)))}
    return "graph LR\n" + "".join(f"  {number[r.src]}[{q(r.src)}] --> {number[r.dst]}[{q(r.dst)}]\n" for r in rows)
