"""Operator 9 against the library, and its round trip."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import pieces
from lodestrata.llm.pieces import Pieces, RunIds, decode, encode

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DDL = "doc_id long, text string"


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_documents_as_the_library(spark, sf):
    sp = library()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    coded = encode(docs)
    for r in coded.collect():
        assert list(r.ids) == sp.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip
    assert {r.doc_id: r.text for r in decode(coded).collect()} == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcdeEst.,'é日本🙂 "), st.characters(blacklist_categories=["Cs"], blacklist_characters="\0▁")), max_size=60))
def test_any_text_as_the_library(text):
    p = Pieces.get(MODEL)
    got = p.encode(text)
    assert got == library().encode(text)
    assert p.decode(got) == text


def test_backtracking_equals_merging():
    p, rng = Pieces.get(MODEL), random.Random(1)
    letters = "aaabbcdehilnorstttu"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30)))
        assert [p.id_of[x] for x in p.merge(s)[0]] == p.backtrack(s)


def test_bitfield_keeps_long_runs_linear():
    p = Pieces.get(MODEL)
    s = "a" * 20_000 + "tion" * 5_000
    assert [p.id_of[x] for x in p.merge(s)[0]] == p.backtrack(s)


def test_runs_equal_texts():
    t, p = RunIds.get(MODEL), Pieces.get(MODEL)
    texts = ["a  b", "", " x", "line\n\nline", "ünï çödé", "a" * 300]
    bounds, ids = t.of(texts)
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))] == [p.encode(x) for x in texts]


def test_defined_results(spark):
    rows = [(None, "words", 1), (1, None, 2), (2, "", 3), (3, "same", None), (3, "same", 5), (4, "long text " * 100_000, 6), (5, "a▁b", 7), (6, "  two  blanks  ", 8)]
    df = spark.createDataFrame(rows, DDL + ", ids long").selectExpr("*", "ids AS n_tokens")
    got = encode(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and by[1][0].ids is None and by[1][0].n_tokens in (0, None) and list(by[2][0].ids) == []
    assert by[3][0].ids == by[3][1].ids and by[4][0].round_trip and by[6][0].round_trip and by[5][0].round_trip is False
    assert decode(encode(df)).count() == len(rows)
    assert encode(spark.createDataFrame([], DDL)).count() == 0


def test_columns_that_differ_in_case(spark):
    from lodestrata.llm.common import pick

    df = spark.createDataFrame([(1, "a", "b", 2)], "doc_id long, TEXT string, text string, Lang long")
    assert pick(df, "doc_id", "text", "lang").collect() == [(1, "b", 2)] and pick(df, "TEXT").columns == ["TEXT"]
    assert pick(spark.createDataFrame([("a",)], "TEXT string"), "text").collect() == [("a",)]


def test_workers_give_memory_back_before_they_encode(monkeypatch):
    """What earlier stages' tasks have freed goes back to the system before the model is read."""
    told = []

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(pieces, "pick", lambda docs, *cols: docs)
    monkeypatch.setattr(pieces, "trim", lambda: told.append("trim"))
    monkeypatch.setattr(RunIds, "get", classmethod(lambda cls, path: told.append("model")))
    assert list(encode(Docs())(iter([]))) == [] and told == ["trim", "model"]
