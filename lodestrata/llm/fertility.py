"""Quality rules by tokeniser fertility (operator 5).

Three public vocabularies' behaviour on a text: characters per token of a byte-level BPE and of a piece BPE, the share of
the piece BPE's tokens that are byte fallback, and the entropy of its tokens. Tokens depend only on the run of non-blanks
(with its leading blank) that they lie in, so each distinct run is tokenised once a task and the rest is table look-up.

Bands. A text is rejected where a measure lies outside the band of its language. fit_bands() fits them on all rows that are
labelled good, by exact quantiles: about the median of each measure, as far as nearly all good rows of that language go, in
units that shrink with the root of the tokens (a long text has to be nearer to the median than a short one), and SLACK times
that. A language with fewer than FIT_LEAST good rows takes the wide bands of BANDS; one that has none there takes those of its
script (that of most of its letters), a script without bands takes "*". Entropy is given as a share of the most it could be
for as many tokens, since short texts have few tokens; texts under MIN_TOKENS are not held to it.

Defined results: a null or empty text has 0 tokens, null measures and is rejected as "empty"; a null language takes the
script's bands; of scripts with as many letters the first by name counts, OTHER where there are no letters; a null id is
carried along; repeated rows are measured each (for the fit an id counts once); whole texts are read, however long; an empty
table gives an empty one; other columns are not looked at, and keep_good() hands them on, whatever their names. Labels that
are missing, null or of unknown ids fit nothing.
"""

from __future__ import annotations

import base64
import itertools
import math
import re
import unicodedata
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import arrow_schema, batches, has_table, pick, read_table, ship, stored

#: Blanks as both tokenisers know them. No token of either holds a blank behind a non-blank, so a text can be cut before each run of blanks.
_W = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{_W}]*[^{_W}]+|[{_W}]+")
#: No statement on how repetitive so short a text is.
MIN_TOKENS = 48
#: (least, most) characters per token of the byte BPE, the same of the piece BPE, most byte-fallback share, least share of the possible entropy.
BANDS: dict[str, tuple[float, float, float, float, float, float]] = {
    "en": (1.2, 12.0, 1.2, 12.0, 0.10, 0.55),
    "de": (1.2, 12.0, 1.2, 12.0, 0.10, 0.55),
    "fr": (1.0, 12.0, 1.2, 12.0, 0.10, 0.55),
    "es": (1.0, 12.0, 1.2, 12.0, 0.10, 0.55),
    "LATIN": (1.0, 14.0, 1.0, 14.0, 0.20, 0.5),
    "CYRILLIC": (0.4, 12.0, 0.8, 12.0, 0.30, 0.45),
    "GREEK": (0.4, 12.0, 0.5, 12.0, 0.40, 0.4),
    "ARABIC": (0.3, 12.0, 0.5, 12.0, 0.60, 0.35),
    "CJK": (0.25, 6.0, 0.25, 6.0, 1.0, 0.35),
    "*": (0.2, 20.0, 0.2, 20.0, 1.0, 0.3),
}
#: Good rows that bands are fitted on, at least for a language; part of them that may lie outside on each side, and what the rest is widened by.
FIT_LEAST, OUTSIDE, SLACK = 50, 0.001, 1.5
#: What bands are fitted on, and the bins of a round of that.
MEASURES, BINS = ("n_tokens", "chars_per_byte_token", "chars_per_piece_token", "byte_share", "entropy_share"), 256
SCHEMA = "doc_id long,lang string,script string,n_chars long,n_tokens long,chars_per_byte_token double,chars_per_piece_token double,byte_share double,entropy double,entropy_share double,keep boolean,reason string"
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARABIC", "HEBREW", "CJK", "HIRAGANA", "KATAKANA", "HANGUL", "DEVANAGARI", "THAI")


def _script_of(ch: str) -> str:
    name = unicodedata.name(ch, "")
    return next((s for s in _SCRIPTS if name.startswith(s)), "OTHER")


def script_of(text: str, seen: dict[int, str]) -> str:
    """The script of most letters; of equals the first by name; OTHER where there is no letter."""
    counts = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
    c: Counter[str] = Counter()
    for o in np.nonzero(counts)[0].tolist():
        if o not in seen:
            seen[o] = _script_of(chr(o)) if chr(o).isalpha() else ""
        if seen[o]:
            c[seen[o]] += int(counts[o])
    return min(c, key=lambda s: (-c[s], s)) if c else "OTHER"


class Vocabularies:
    """Run of non-blanks -> (number, the byte BPE's count, the piece BPE's ids); loaded once a Python worker."""

    _one: dict[str, Vocabularies] = {}

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pat = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bytes_bpe = tiktoken.Encoding("byte_bpe", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        self.piece_bpe = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.is_byte = np.array([self.piece_bpe.is_byte(i) for i in range(self.piece_bpe.get_piece_size())])

    @classmethod
    def get(cls, folder: str) -> Vocabularies:
        if folder not in cls._one:
            cls._one[folder] = cls(folder)
        return cls._one[folder]


class RunTable:
    """What is known of the runs met so far; starts over at `most`, so that a long task keeps to its memory."""

    def __init__(self, v: Vocabularies, most: int = 400_000):
        self.v, self.most = v, most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.n_byte = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, texts: list[list[str]]) -> None:
        if len(self.index) > self.most:
            self.clear()
        new = list({r for runs in texts for r in runs}.difference(self.index))
        if not new:
            return
        enc = self.v.bytes_bpe._core_bpe.encode_ordinary
        # a text's first run is marked by a NUL; the piece BPE puts a blank before it
        nb = np.fromiter((len(enc(r[1:] if r[0] == "\0" else r)) for r in new), np.int64, len(new))
        bare = [r[0] not in " \0" or r == " " for r in new]
        # a run that begins with another blank gets no blank in front, and of a lone one nothing would be left: it is encoded behind a line feed, and both their ids dropped
        got = self.v.piece_bpe.encode(["\n" + r if b else r[1:] for r, b in zip(new, bare)], num_threads=1)
        got = [g[2:] if b else g for g, b in zip(got, bare)]
        base = len(self.index)
        self.index.update(zip(new, range(base, base + len(new))))
        self.n_byte = np.concatenate([self.n_byte, nb])
        lens = np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(got), np.int32, int(lens.sum()))])


class Fitted(NamedTuple):
    """Of a language: (median, least, most) of three measures, where least and most are distances times the root of the tokens,
    and the least share of the possible entropy."""

    byte: tuple[float, float, float]
    piece: tuple[float, float, float]
    share: tuple[float, float, float]
    entropy: float

    def breaks(self, m: tuple[float, float, float, float, int]) -> str | None:
        cb, cp, share, ent, n = m
        root = n**0.5
        for name, x, (mid, lo, hi) in (("byte_fertility", cb, self.byte), ("piece_fertility", cp, self.piece)):
            if not lo <= (x - mid) * root <= hi:
                return name
        if (share - self.share[0]) * root > self.share[2]:
            return "byte_fallback"
        return "token_entropy" if n >= MIN_TOKENS and ent < self.entropy else None


def judge(lang: str | None, script: str, m: tuple[float, float, float, float, int], bands: dict) -> str | None:
    """The first band that the measures break, by name."""
    if isinstance(fit := bands.get(lang or ""), Fitted):
        return fit.breaks(m)
    lo_b, hi_b, lo_p, hi_p, most_bytes, least = bands.get(lang or "", bands.get(script, bands["*"]))
    cb, cp, share, ent, n = m
    if not lo_b <= cb <= hi_b:
        return "byte_fertility"
    if not lo_p <= cp <= hi_p:
        return "piece_fertility"
    if share > most_bytes:
        return "byte_fallback"
    if n >= MIN_TOKENS and ent < least:
        return "token_entropy"
    return None


def measure(texts: list[str | None], langs: list[str | None], table: RunTable, bands: dict, seen: dict[int, str]) -> dict[str, list]:
    runs = [CHUNK.findall(t) if t else [] for t in texts]
    for rs in runs:
        if rs:
            rs[0] = "\0" + rs[0]
    table.add(runs)
    get = table.index.__getitem__
    out: dict[str, list] = {c: [] for c in [x.split()[0] for x in SCHEMA.split(",")][2:]}
    isb = table.v.is_byte
    for t, lang, rs in zip(texts, langs, runs):
        if not rs:
            row = (None, len(t or ""), 0, None, None, None, None, None, False, "empty")
        else:
            k = np.fromiter(map(get, rs), np.int64, len(rs))
            lens = table.start[k + 1] - table.start[k]
            total = int(lens.sum())
            ends = np.cumsum(lens)
            at = np.arange(total) - np.repeat(ends - lens, lens) + np.repeat(table.start[k], lens)
            ids = table.ids[at]
            counts = np.bincount(ids)
            counts = counts[counts > 0]
            p = counts / max(total, 1)
            h = float(-(p * np.log2(p)).sum()) if total else 0.0
            nb = int(table.n_byte[k].sum())
            cb, cp = len(t) / max(nb, 1), len(t) / max(total, 1)
            share = float(isb[ids].mean()) if total else 0.0
            # what many draws from a common vocabulary can reach is bounded by the draws at first and by the vocabulary later
            most = np.log2(min(total, 1024)) if total > 1 else 1.0
            es = min(1.0, h / most)
            script = script_of(t, seen)
            why = judge(lang, script, (cb, cp, share, es, total), bands)
            row = (script, len(t), total, cb, cp, share, h, es, why is None, why)
        for c, v in zip(out, row):
            out[c].append(v)
    return out


def fertility(docs: DataFrame, folder: str = "/opt/tokenizers", bands: dict | None = None) -> DataFrame:
    """One row a document: its measures, whether it stays, and the first rule it breaks. No shuffle."""
    bands, schema = bands or BANDS, arrow_schema(SCHEMA)

    def run(it):
        table, seen = RunTable(Vocabularies.get(folder)), {}
        for ids, texts, langs in batches(it, "doc_id", "text", "lang"):
            for i in range(0, len(ids), 512):
                m = measure(texts[i : i + 512], langs[i : i + 512], table, bands, seen)
                yield pa.RecordBatch.from_pydict({"doc_id": ids[i : i + 512], "lang": langs[i : i + 512]} | m, schema=schema)

    return pick(docs, "doc_id", "text", "lang").mapInArrow(run, SCHEMA)


def histograms(x: DataFrame, series: list[tuple], within: list[tuple[int, float, float]]) -> dict[int, list[tuple[int, int, float, float]]]:
    """Of each (series, least, most) in `within`: (bin, values, least, most) of BINS bins of its values from least to most. A series
    is (language, column, of long texts only, median or None); with a median it is the distances from it times the root of the tokens."""

    def run(it):
        held: dict[tuple[int, int], list] = {}
        for b in it:
            cols = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in MEASURES}
            n, langs = cols["n_tokens"], b.column(b.schema.get_field_index("lang"))
            of = {lang: pc.equal(langs, lang).to_numpy(zero_copy_only=False) for lang in {series[s][0] for s, _, _ in within}}
            for at, (s, lo, hi) in enumerate(within):
                lang, c, long, mid = series[s]
                v = cols[c][of[lang] & (n >= MIN_TOKENS) if long else of[lang]]
                if mid is not None:
                    v = (v - mid) * np.sqrt(n[of[lang]])
                v = v[(v >= lo) & (v <= hi)]
                part = np.minimum((v - lo) / (hi - lo) * BINS, BINS - 1).astype(np.int64) if np.isfinite(hi) else np.zeros(len(v), np.int64)
                order = np.lexsort((v, part))
                v, part = v[order], part[order]
                heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(v)])
                ends = np.append(heads[1:], len(v))
                for i, j in zip(heads.tolist(), ends.tolist()):
                    got = held.setdefault((at, int(part[i])), [0, np.inf, -np.inf])
                    got[:] = got[0] + j - i, min(got[1], float(v[i])), max(got[2], float(v[j - 1]))
        rows = [(*k, *h) for k, h in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    ddl = "at long,bin long,n long,lo double,hi double"
    schema = arrow_schema(ddl)
    got = x.select("lang", *MEASURES).mapInArrow(run, ddl).groupBy("at", "bin").agg(F.sum("n"), F.min("lo"), F.max("hi")).collect()
    out: dict[int, list] = {at: [] for at in range(len(within))}
    for at, *r in sorted(tuple(r) for r in got):
        out[at].append(tuple(r))
    return out


def quantiles(x: DataFrame, wanted: list[tuple[tuple, float, int]]) -> list[float]:
    """The exact quantile of each (series, share, its number of values), interpolated as numpy does. Its two neighbours in order are
    closed in on by rounds of histograms, so that neither a task nor the driver holds the values."""
    series = sorted({s for s, _, _ in wanted}, key=str)
    spots = [(series.index(s), math.floor(q * (n - 1)) + i) for s, q, n in wanted for i in (0, 1) if math.floor(q * (n - 1)) + i < n]
    # (series, place): least, most and the place among the values from least to most
    todo = {spot: (-math.inf, math.inf, spot[1]) for spot in spots}
    value: dict[tuple[int, int], float] = {}
    while todo:
        within = sorted({(s, lo, hi) for (s, _), (lo, hi, _) in todo.items()})
        found = dict(zip(within, histograms(x, series, within).values()))
        for spot, (lo, hi, place) in list(todo.items()):
            for _, n, least, most in found[spot[0], lo, hi]:
                if place < n:
                    break
                place -= n
            if place in (0, n - 1):
                value[spot] = least if place == 0 else most
                del todo[spot]
            elif least == most:
                value[spot] = least
                del todo[spot]
            else:
                todo[spot] = least, most, place
    out = []
    for s, q, n in wanted:
        at = math.floor(q * (n - 1))
        lo = value[series.index(s), at]
        hi = value.get((series.index(s), at + 1), lo)
        out.append(lo + (hi - lo) * (q * (n - 1) - at))
    return out


def fit_bands(docs: DataFrame, labels: DataFrame, folder: str = "/opt/tokenizers", least: int = FIT_LEAST, measured: DataFrame | None = None) -> dict:
    """BANDS with fitted ones for the languages of rows labelled good (quality 1), of all of them. `measured` is what fertility()
    tells of docs, where it is there already. What is shuffled and kept are numbers, never texts."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    measured = fertility(docs, folder) if measured is None else measured
    some = measured.filter("lang IS NOT NULL AND n_tokens > 0").select("doc_id", "lang", *MEASURES).join(good, "doc_id", "left_semi")
    x = stored(some.groupBy("doc_id").agg(F.min(F.struct("lang", *MEASURES)).alias("x")).select("x.*"), "fit")
    sizes = {r[0]: (r[1], r[2]) for r in x.groupBy("lang").agg(F.count(F.lit(1)), F.count_if(F.col("n_tokens") >= MIN_TOKENS)).collect() if r[1] >= least}
    if not sizes:
        return dict(BANDS)
    # medians of the long texts, or of all where none is long
    ask = [((lang, c, long > 0, None), 0.5, long or n) for lang, (n, long) in sizes.items() for c in MEASURES[1:4]]
    ask += [((lang, "entropy_share", True, None), q, long) for lang, (n, long) in sizes.items() if long for q in (0.5, OUTSIDE)]
    mids = {(s[0], s[1], q): v for (s, q, _), v in zip(ask, quantiles(x, ask))}
    ask = [((lang, c, False, mids[lang, c, 0.5]), q, n) for lang, (n, _) in sizes.items() for c in MEASURES[1:4] for q in (OUTSIDE, 1 - OUTSIDE)]
    ends = {(s[0], s[1], q): v * SLACK for (s, q, _), v in zip(ask, quantiles(x, ask))}
    out = dict(BANDS)
    for lang in sorted(sizes):
        fit = [(mids[lang, c, 0.5], min(0.0, ends[lang, c, OUTSIDE]), max(0.0, ends[lang, c, 1 - OUTSIDE])) for c in MEASURES[1:4]]
        mid = mids.get((lang, "entropy_share", 0.5))
        out[lang] = Fitted(*fit, 0.0 if mid is None else mid - SLACK * (mid - mids[lang, "entropy_share", OUTSIDE]))
    return out


def judged(measured: DataFrame, bands: dict) -> DataFrame:
    """What fertility() tells with these bands, from what it told with others: texts aren't read again."""
    schema = arrow_schema(SCHEMA)
    cols = ("n_tokens", "chars_per_byte_token", "chars_per_piece_token", "byte_share", "entropy_share")

    def run(it):
        for b in it:
            lang, script, n, *m = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("lang", "script", *cols))
            why = ["empty" if cb is None else judge(la, sc, (cb, cp, share, es, n_), bands) for la, sc, n_, cb, cp, share, es in zip(lang, script, n, *m)]
            told = {"keep": pa.array([y is None for y in why], pa.bool_()), "reason": pa.array(why, pa.string())}
            yield pa.RecordBatch.from_arrays([told[f.name] if f.name in told else b.column(b.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema)

    return measured.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, folder: str = "/opt/tokenizers", bands: dict | None = None) -> DataFrame:
    """The rows, with all their columns, of texts that no rule rejects. No shuffle."""
    bands = bands or BANDS

    def run(it):
        table, seen = RunTable(Vocabularies.get(folder)), {}
        for b in it:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts, langs = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("text", "lang"))
                yield part.filter(pa.array(measure(texts, langs, table, bands, seen)["keep"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def bands_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Bands fitted on the labels beside the documents; the wide ones where there are none."""
    return fit_bands(docs, read_table(spark, sf_dir, "labels")) if has_table(spark, sf_dir, "labels") else BANDS


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read_table(spark, sf_dir, "documents")
    if not has_table(spark, sf_dir, "labels"):
        return fertility(docs)
    measured = stored(fertility(docs), "fertility")
    return judged(measured, fit_bands(docs, read_table(spark, sf_dir, "labels"), measured=measured))
