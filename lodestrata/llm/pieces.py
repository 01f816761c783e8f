"""SentencePiece encoding and decoding, merge type, exact by backtracking (operator 9).

A sequence of pieces is what merging yields if, and only if, each two neighbours of it are what merging yields of them
alone. So a run is encoded from the left with the longest piece that an Aho-Corasick automaton finds there; a piece that
isn't compatible with its predecessor (told by undoing both's merges step by step) gives way to its next shorter prefix, and
where none is left the predecessor is taken back. A bitfield keeps the positions from which no ending was found, so that
none is tried twice and the work stays linear. Characters without a piece become bytes, and runs of several blanks, whose
pieces tie in score, are merged step by step.

No piece holds a blank behind another character, so a text is cut before each run of blanks, and each distinct run is
encoded once a worker.

Defined results: null text gives null ids; an empty text no ids; null ids are carried along, and repeated rows come out each;
an empty table gives an empty one; columns beside doc_id and text are not looked at; whole texts are encoded, however long. A text that itself holds the mark U+2581, which stands for a blank, or no
valid Unicode, doesn't come back the same: round_trip says so for each row.
"""

from __future__ import annotations

import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import pick, read_table, ship, trim

MARK = "▁"
RUN = re.compile("[ ▁\\n]*[^ ▁\\n]+|[ ▁\\n]+")
SCHEMA = "doc_id long,ids array<int>,n_tokens int,n_bytes_tokens int,round_trip boolean"


class Pieces:
    """A merge-type model's tables. Ranks: characters first, then the other pieces in the order in which they are merged."""

    _one: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.trainer_spec.model_type != 2:
            raise ValueError("not a merge-type model")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        normal = [(p.piece, p.score, i) for i, p in enumerate(m.pieces) if p.type == 1]
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        self.is_byte = np.array([p.type == 6 for p in m.pieces])
        self.unk = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.score = {p: s for p, s, _ in normal}
        self.id_of = {p: i for p, _, i in normal}
        self.chars = {p for p in self.score if len(p) == 1}
        order = sorted(normal, key=lambda x: (len(x[0]) > 1, -x[1], x[2]))
        self.rank = {p: r for r, (p, _, _) in enumerate(order)}
        n = len(order)
        self.text = [p for p, _, _ in order]
        self.model_id = [i for _, _, i in order]
        self.left, self.right, self.pair = list(range(n)), list(range(n)), {}
        reachable = []
        for r, p in enumerate(self.text):
            if len(p) == 1:
                reachable.append(r)
            elif set(p) <= self.chars and set(p) != {MARK}:
                parts, last = self.merge(p)
                if len(parts) == 1:
                    self.left[r], self.right[r] = a, b = self.rank[last[0]], self.rank[last[1]]
                    self.pair[a, b] = r
                    reachable.append(r)
        self.auto = ahocorasick.Automaton()
        for r in reachable:
            self.auto.add_word(self.text[r], r)
        self.auto.make_automaton()
        ok = set(reachable)
        self.size = [len(p) for p in self.text]
        #: what a walk in the automaton may spell -> the longest piece that it begins with
        self.at_state: dict[str, int] = {}
        for r in sorted(reachable, key=lambda r: self.size[r]):
            p = self.text[r]
            for k in range(1, len(p)):
                if p[:k] not in self.at_state:
                    self.at_state[p[:k]] = self.at_state[p[: k - 1]]
            self.at_state[p] = r
        self.most = max(self.size)
        self.shorter = [-1] * n
        for r in reachable:
            p = self.text[r]
            self.shorter[r] = next((self.rank[p[:k]] for k in range(len(p) - 1, 0, -1) if self.rank.get(p[:k]) in ok), -1)
        self.known: dict[tuple[int, int], bool] = {}

    @classmethod
    def get(cls, path: str) -> Pieces:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merging as defined, step by step: best score first, of equals the leftmost. With the last two parts merged."""
        sym: list[str | None] = list(s)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0:
                t = sym[i] + sym[j]
                if t in self.score:
                    heapq.heappush(heap, (-self.score[t], i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i)
        last = None
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if sym[i] is not None else -1
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            last = (a, b)
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return [x for x in sym if x is not None], last

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging a's and b's text together ends in a and b: undoes the later merge of both, again and again, and
        looks whether what then meets at the seam would have been merged sooner."""
        key = (a, b)
        if (got := self.known.get(key)) is not None:
            return got
        left, right, pair, limit, ok = self.left, self.right, self.pair, 1 << 60, True
        while True:
            c = pair.get((a, b))
            if c is not None and c < limit:
                ok = False
                break
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        break
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        break
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[key] = ok
        return ok

    def longest(self, s: str, pos: int) -> int:
        """The longest piece at pos: what the automaton's walk from there spells ends in a state whose longest piece is known."""
        part = s[pos : pos + self.most]
        return self.at_state[part[: self.auto.longest_prefix(part)]]

    def backtrack(self, s: str) -> list[int]:
        """Model ids of s, whose characters all have pieces and that holds no two blanks in a row."""
        ids, size, known = self.model_id, self.size, self.known
        # first the automaton's longest matches from left to right, which mostly are compatible as they are
        out = [r for _, r in self.auto.iter_long(s)]
        last = -1
        for t in out:
            if last >= 0 and not (known[last, t] if (last, t) in known else self.compatible(last, t)):
                break
            last = t
        else:
            return [ids[t] for t in out]
        n = len(s)
        open_, out, pos, tok = (1 << (n + 1)) - 1, [], 0, self.longest(s, 0)
        while True:
            last = out[-1] if out else -1
            while True:
                end = pos + size[tok]
                if open_ >> end & 1 and (last < 0 or self.compatible(last, tok)):
                    out.append(tok)
                    pos = end
                    if pos == n:
                        return [ids[t] for t in out]
                    tok = self.longest(s, pos)
                    break
                tok = self.shorter[tok]
                if tok < 0:
                    if last < 0:
                        raise ValueError("no encoding: the vocabulary lacks a character of this run")
                    open_ &= ~(1 << pos)
                    out.pop()
                    pos -= size[last]
                    tok = last
                    break

    def encode_run(self, run: str) -> list[int]:
        s = run.replace(" ", MARK)
        if self.chars.issuperset(s) and MARK + MARK not in s:
            return self.backtrack(s)
        out: list[int] = []
        for known, part in itertools.groupby(s, self.chars.__contains__):
            p = "".join(part)
            if not known:
                bs = p.encode("utf-8", "surrogatepass")
                out += [self.byte_id[b] for b in bs] if self.byte_id else [self.unk] * len(p)
            elif MARK + MARK in p:
                out += [self.id_of[x] for x in self.merge(p)[0]]
            else:
                out += self.backtrack(p)
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for r in RUN.findall((" " if self.prefix else "") + text) for i in self.encode_run(r)]

    def decode(self, ids: list[int]) -> str:
        s = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return s[1:] if self.prefix and s[:1] == " " else s


class RunIds:
    """Ids of the runs met so far by this worker, end to end."""

    _one: dict[str, RunIds] = {}

    def __init__(self, model: Pieces, most: int = 800_000):
        self.model, self.most = model, most
        self.clear()

    @classmethod
    def get(cls, path: str) -> RunIds:
        if path not in cls._one:
            cls._one[path] = cls(Pieces.get(path))
        return cls._one[path]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and all their ids."""
        front = " " if self.model.prefix else ""
        runs = [RUN.findall(front + t) if t else [] for t in texts]
        if len(self.index) > self.most:
            self.clear()
        new = list({r for rs in runs for r in rs}.difference(self.index))
        if new:
            got = [self.model.encode_run(r) for r in new]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            lens = np.fromiter(map(len, got), np.int64, len(got))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens)])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(got), np.int32, int(lens.sum()))])
        n_runs = np.fromiter(map(len, runs), np.int64, len(runs))
        k = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(runs)), np.int64, int(n_runs.sum()))
        lens = self.start[k + 1] - self.start[k]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - lens, lens) + np.repeat(self.start[k], lens)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_runs)])]
        return bounds, self.ids[at]


def encode(docs: DataFrame, model: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids, how many, how many of them bytes, and whether decoding the ids gives the text again. No shuffle."""

    def run(it):
        trim()
        t = RunIds.get(model)
        for b in it:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                bounds, ids = t.of([x or "" for x in texts])
                some = ids.tolist()
                same = [None if x is None else t.model.decode(some[bounds[j] : bounds[j + 1]]) == x for j, x in enumerate(texts)]
                null = pa.array([x is None for x in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                nb = np.concatenate([[0], np.cumsum(t.model.is_byte[ids])])
                n_byte = nb[bounds[1:]] - nb[bounds[:-1]]
                cols = [part.column(part.schema.get_field_index("doc_id")), lists, pa.array(np.diff(bounds), pa.int32()), pa.array(n_byte, pa.int32()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_tokens", "n_bytes_tokens", "round_trip"])

    return pick(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def decode(coded: DataFrame, model: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """doc_id and the text of its ids; null ids give a null text."""

    def run(it):
        m = Pieces.get(model)
        for b in it:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([None if x is None else m.decode(x) for x in ids], pa.string())], names=["doc_id", "text"])

    return pick(coded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode(read_table(spark, sf_dir, "documents"))
