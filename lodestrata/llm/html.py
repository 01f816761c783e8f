"""Main text by consensus of a host's pages (operator 8).

1. Each page's containers are scored: a block's text (less its links') counts for the container that holds it, and half for
   the one around that. The best one casts the page's vote for its generalised path: tags with their classes, digits taken
   out, ids and positions left out.
2. Spark counts the votes of each host; the path of most votes wins (of equals that of the higher score, then the first).
3. Each page is taken apart once more and gives the text of the containers on its host's path; a page without one falls back
   to its own best container. The winners, a row a host, are broadcast if they have no more than HELD_BYTES; else they and the
   pages are shuffled by host and salt. So pages move only where there are very many hosts, and no host is one task's work.

The parser is a scanner over tags with a stack: it skips comments, scripts and styles, closes what HTML lets stay open (p, li,
td, option ...), and passes over stray ends. A '>' in a quoted value doesn't end a tag; where a quote so never ends, or a
tag with it, quotes are ordinary from there on. Each place of a page is looked at a bounded number of times, open tags are
found by their places on the stack, and paths are links to the path above, so that time and memory are in proportion to the page.

Defined results: null or empty html gives a null text, by "none"; a null url, or one without a host, has no consensus and
takes the page's own container; null ids are carried along; repeated rows vote each and come out each; an empty table gives
no rows; columns beside page_id, url and html are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_schema, batches, pick, read_table, ship, stored

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: What ends a tag or opens a quoted value.
STOP = re.compile(r"""=\s*(["'])|>""")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea".split()}
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body main article section div td th nav aside header footer form ul ol dl table tbody tr blockquote center fieldset details".split())
BLOCKS = frozenset("p li dt dd pre h1 h2 h3 h4 h5 h6 figcaption caption title head html".split()) | CONTAINERS
#: What a start tag closes, up to the nearest of the second set.
CLOSES = {t: (frozenset(["p"]), frozenset("body div article section main td th li blockquote table".split())) for t in BLOCKS - {"html", "head", "body"}}
CLOSES["li"] = (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"]))
for _t in ("dt", "dd"):
    CLOSES[_t] = (frozenset(["dt", "dd", "p"]), frozenset(["dl"]))
for _t in ("td", "th"):
    CLOSES[_t] = (frozenset(["td", "th", "p"]), frozenset(["tr", "table"]))
CLOSES["tr"] = (frozenset(["tr", "td", "th", "p"]), frozenset(["table", "tbody", "thead"]))
CLOSES["option"] = (frozenset(["option"]), frozenset(["select"]))
DIGITS = re.compile(r"\d+")
BLANKS = re.compile(r"[ \t\r\f\v]*\n[ \t\r\f\v\n]*|[ \t\r\f\v]+")
#: Bytes of hosts and their paths that are broadcast, and parts that a host's pages are in beyond that.
HELD_BYTES, SALTS = 32 << 20, 16
SCHEMA = "page_id long,host string,path string,how string,text string,n_chars int"


class Container:
    """number is that of the path among the page's; depth are the containers around it."""

    __slots__ = ("number", "step", "depth", "score", "start", "end", "up")

    def __init__(self, number: int, step: str, up: Container | None, start: int):
        self.number, self.step, self.up, self.score, self.start, self.end = number, step, up, 0, start, 0
        self.depth = 0 if up is None else up.depth + 1

    @property
    def path(self) -> str:
        steps, c = [], self
        while c is not None and c.step:
            steps.append(c.step)
            c = c.up
        return ">".join(reversed(steps))


def step(tag: str, attrs: str) -> str:
    m = CLASS.search(attrs) if attrs else None
    if not m:
        return tag
    names = sorted({DIGITS.sub("#", c) for c in (m[1] or m[2] or m[3] or "").lower().replace(">", "_").split()})
    return ".".join([tag, *names])


def tags(html: str):
    """(start, end, tag or None, whether it ends one, attributes) of each piece that isn't text; None: a comment and the like."""
    at, quotes = 0, True
    while (lt := html.find("<", at)) >= 0:
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            end = len(html) if end < 0 else end + 3
            yield lt, end, None, False, ""
            at = end
            continue
        m = NAME.match(html, lt)
        if m is None:
            if html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                if end < 0:
                    return
                yield lt, end + 1, None, False, ""
                at = end + 1
            else:
                at = lt + 1
            continue
        end, k = -1, m.end()
        while quotes:
            stop = STOP.search(html, k)
            if stop is None:
                quotes = False
            elif stop[1] is None:
                end = stop.start()
                break
            elif (k := html.find(stop[1], stop.end()) + 1) == 0:
                quotes = False
        if end < 0:
            end = html.find(">", m.end())
            if end < 0:
                return
        tag, ends = m[1].lower(), html[lt + 1] == "/"
        attrs = html[m.end() : end]
        at = end + 1
        if tag in RAW and not ends:
            close = RAW[tag].search(html, at)
            at = len(html) if close is None else close.end()
            tag = None
        yield lt, at, tag, ends, attrs


def take_apart(html: str) -> tuple[list[Container], list[str], dict[tuple[int, str], int]]:
    """Containers in document order, with scores (twice the characters); the texts between tags, a container's being
    texts[start:end]; and the numbers of paths by the number of the path above and the last step."""
    texts: list[str] = []
    root = Container(0, "", None, 0)
    numbers: dict[tuple[int, str], int] = {}
    found: list[Container] = []
    stack: list[tuple[str, Container]] = [("", root)]
    places: dict[str, list[int]] = {}
    at, links, block, block_links, owner = 0, 0, 0, 0, root

    def close_block():
        nonlocal block, block_links
        worth = block - 2 * block_links
        if worth > 0:
            owner.score += 2 * worth
            if owner.up is not None:
                owner.up.score += worth
        block = block_links = 0

    def pop():
        nonlocal links
        tag, c = stack.pop()
        places[tag].pop()
        if tag == "a":
            links -= 1
        if tag in BLOCKS:
            texts.append("\n")
        if c is not stack[-1][1]:
            c.end = len(texts)

    for start, end, tag, ends, attrs in tags(html):
        if start > at:
            t = html[at:start]
            texts.append(t)
            n = len(t.strip())
            if stack[-1][0] not in ("title", "head"):
                block += n
                if links:
                    block_links += n
        at = end
        if tag is None:
            continue
        if tag == "br" or tag == "hr":
            texts.append("\n")
            continue
        if tag in VOID:
            continue
        if ends:
            if places.get(tag):
                if tag in BLOCKS:
                    close_block()
                while stack[-1][0] != tag:
                    pop()
                pop()
                owner = stack[-1][1]
            continue
        if tag in BLOCKS:
            close_block()
            if tag in CLOSES:
                inner, outer = CLOSES[tag]
                wall = max((places[t][-1] for t in outer if places.get(t)), default=0)
                first = [p[k] for t in inner if (p := places.get(t)) and (k := bisect_right(p, wall)) < len(p)]
                if first:
                    while len(stack) > min(first):
                        pop()
            texts.append("\n")
        up = stack[-1][1]
        if tag in CONTAINERS:
            key = up.number, step(tag, attrs)
            c = Container(numbers.setdefault(key, len(numbers) + 1), key[1], up, len(texts))
            found.append(c)
        else:
            c = up
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, c))
        owner = c
        if tag == "a":
            links += 1
    if at < len(html):
        t = html[at:]
        texts.append(t)
        block += len(t.strip())
        block_links += len(t.strip()) if links else 0
    close_block()
    while len(stack) > 1:
        pop()
    root.end = len(texts)
    return found or [root], texts, numbers


def best(found: list[Container]) -> Container:
    """The highest score; of equals the deeper one, then the first."""
    return max(found, key=lambda c: (c.score, c.depth, -c.start))


def on_path(found: list[Container], numbers: dict[tuple[int, str], int], path: str) -> list[Container]:
    at = 0
    for part in path.split(">"):
        at = numbers.get((at, part), -1)
        if at < 0:
            return []
    return [c for c in found if c.number == at]


def text_of(parts: list[str]) -> str:
    s = BLANKS.sub(lambda m: "\n" if "\n" in m[0] else " ", unescape("".join(parts)))
    return "\n".join(x for line in s.split("\n") if (x := line.strip()))


def host_of(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(h != "", h)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, score) of each page's best container."""
    ddl = "host string,path string,score long"
    schema = arrow_schema(ddl)

    def run(it):
        for hosts, htmls in batches(it, "host", "html"):
            got = [(h, c.path, c.score) for h, x in zip(hosts, htmls) if x and (c := best(take_apart(x)[0])).score > 0]
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*got))) if got else {c: [] for c in schema.names}, schema=schema)

    return pages.filter("host IS NOT NULL").select("host", "html").mapInArrow(run, ddl)


def winners(v: DataFrame) -> DataFrame:
    """(host, winner): each host's path of most votes."""
    c = v.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    order = W.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path")
    return c.withColumn("r", F.row_number().over(order)).filter("r = 1").select("host", F.col("path").alias("winner"))


def main_text(pages: DataFrame, held: int = HELD_BYTES) -> DataFrame:
    """page_id, host, the path taken, how (consensus, own, none), the text and its length."""
    p = pick(pages, "page_id", "url", "html").select("page_id", host_of(F.col("url")).alias("host"), "html")
    schema = arrow_schema(SCHEMA)

    def run(it):
        for ids, hosts, htmls, wins in batches(it, "page_id", "host", "html", "winner"):
            rows = []
            for d, h, x, w in zip(ids, hosts, htmls, wins):
                if not x:
                    rows.append((d, h, None, "none", None, None))
                    continue
                found, texts, numbers = take_apart(x)
                mine = on_path(found, numbers, w) if w is not None else []
                how, path = "consensus", w
                if not mine:
                    how, mine = "own", [best(found)]
                    path = mine[0].path
                parts, upto = [], -1
                for c in mine:  # of containers within each other the outer one
                    if c.start >= upto:
                        parts += texts[c.start : c.end]
                        parts.append("\n")
                        upto = c.end
                t = text_of(parts)
                rows.append((d, h, path, how, t, len(t)))
            yield pa.RecordBatch.from_pydict({c: [r[i] for r in rows] for i, c in enumerate(schema.names)}, schema=schema)

    w = stored(winners(votes(p)), "winners")
    size = w.agg(F.sum(F.octet_length("host") + F.octet_length("winner") + 64)).first()[0] or 0
    if size <= held:
        both = p.join(F.broadcast(w), "host", "left")
    else:
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int"))
        both = p.join(w.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("shuffle_hash"), ["host", "salt"], "left")
    return both.select("page_id", "host", "html", "winner").mapInArrow(run, SCHEMA)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return main_text(read_table(spark, sf_dir, "pages"))
