"""Operator 5 against whole-text tokenising with the libraries."""

import math
import random
from collections import Counter

import numpy as np

from lodestrata.llm.fertility import BANDS, Fitted, Vocabularies, bands_of, fertility, fit_bands, judged, keep_good

DDL = "doc_id long, text string, lang string"
FOLDER = "/opt/tokenizers"
ODD = ["a  b   c", " lead", "trail ", "\n\nx\n", "tab\tend\r\n", "日本語のテキスト", "🙂🙂 smile", "a b　c", "x y", "it's they're I'LL", "▁mark", "café́", "0123456789 " * 5, "  ", "a" * 500]


def measures(text):
    v = Vocabularies.get(FOLDER)
    nb, ids = len(v.bytes_bpe.encode_ordinary(text)), v.piece_bpe.encode(text)
    p = [c / len(ids) for c in Counter(ids).values()]
    return len(text) / max(nb, 1), len(text) / max(len(ids), 1), sum(bool(v.is_byte[i]) for i in ids) / max(len(ids), 1), -sum(x * math.log2(x) for x in p), len(ids)


def test_against_whole_texts(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + i, t, None) for i, t in enumerate(ODD)]
    for r in fertility(spark.createDataFrame(rows, DDL)).collect():
        t = next(t for d, t, _ in rows if d == r.doc_id)
        if t:
            want = measures(t)
            got = r.chars_per_byte_token, r.chars_per_piece_token, r.byte_share, r.entropy, r.n_tokens
            assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (t[:60], got, want)


def test_clean_documents_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").select("doc_id")
    good = docs.join(good, "doc_id").select("doc_id").distinct()
    kept = keep_good(docs).join(good, "doc_id").select("doc_id").distinct()
    assert kept.count() >= 0.98 * good.count()


def test_fitted_bands_reject_what_is_labelled_bad(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    bands = bands_of(spark, docs, at)
    assert isinstance(bands["en"], Fitted)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    by = {0: Counter(), 1: Counter()}
    for r in fertility(docs, bands=bands).filter("reason IS NULL OR reason != 'empty'").collect():
        if r.doc_id in quality:
            by[quality[r.doc_id]][r.reason] += 1
    assert by[1][None] >= 0.99 * sum(by[1].values()) and by[0][None] <= 0.3 * sum(by[0].values())
    assert by[0]["byte_fertility"] > 5 and by[0]["token_entropy"] > 5


def test_bands_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", "en"), (2, None, "en")], DDL)
    kinds = "doc_id long, quality int, extra string"
    for rows in ([], [(None, 1, "x"), (7, 1, None), (2, 1, None), (1, None, None), (1, 1, "y"), (1, 1, "z")]):
        assert fit_bands(docs, spark.createDataFrame(rows, kinds)) == BANDS
    bands = fit_bands(docs, spark.createDataFrame([(1, 1, "y")], kinds), least=1)
    assert isinstance(bands["en"], Fitted) and keep_good(docs, bands=bands).count() == 1
    assert bands_of(spark, docs, "/nowhere") == BANDS


def test_bands(spark):
    word = "the quick brown fox jumps over the lazy dog and runs away from here "
    rows = [(1, word * 3, "en"), (2, "a " * 400, "en"), (3, "ᚠᚱༀ" * 60, "en"), (4, "日本語のテキストです。これは普通の文章であり、", "ja"), (5, "Это обычный текст на русском языке, без повторов и мусора.", None), (6, "%$#@ " * 100, None)]
    got = {r.doc_id: r for r in fertility(spark.createDataFrame(rows, DDL)).collect()}
    assert got[1].keep and got[4].keep and got[5].keep
    assert got[2].reason == "token_entropy" or got[2].reason == "byte_fertility" or not got[2].keep
    assert not got[3].keep and got[5].script == "CYRILLIC" and got[4].script in ("HIRAGANA", "KATAKANA", "CJK")
    tight = {**BANDS, "en": (5.0, 6.0, 1, 12, 1, 0)}
    assert {r.doc_id: r.reason for r in fertility(spark.createDataFrame(rows[:1], DDL), bands=tight).collect()}[1] in (None, "byte_fertility")


def test_defined_results(spark):
    rows = [(None, "some words here", "en", 1), (1, None, "en", 2), (2, "", None, 3), (3, "x y z", None, None), (3, "x y z", None, 5), (4, "word " * 200_000, "en", 6), (5, "many different words " * 3, "zz", 7)]
    df = spark.createDataFrame(rows, DDL + ", keep long").selectExpr("*", "keep AS reason", "keep AS script")
    got = fertility(df).collect()
    assert len(got) == 7 and {r.doc_id for r in got if r.reason == "empty"} == {1, 2}
    assert next(r for r in got if r.doc_id == 4).n_chars == 1_000_000
    left = keep_good(df)
    assert left.columns == df.columns and {1, 2}.isdisjoint({r.doc_id for r in left.collect()})
    assert fertility(spark.createDataFrame([], DDL)).count() == 0 and keep_good(spark.createDataFrame([], DDL)).count() == 0


def test_bands_are_fitted_on_all_good_rows(spark):
    rng = random.Random(4)
    rows = [(d, " ".join(rng.choice(["a", "the", "word", "longer", "extraordinary", "é"]) for _ in range(rng.choice([3, 10, 60]))), "en" if d % 3 else "de") for d in range(20_300)]
    docs = spark.createDataFrame(rows, DDL).repartition(4)
    x = fertility(docs).toPandas()
    bands = fit_bands(docs, docs.selectExpr("doc_id", "1 AS quality"))
    for lang in ("en", "de"):
        m = x[x.lang == lang]
        long = (m.n_tokens >= 48).to_numpy()
        for c, got in zip(("chars_per_byte_token", "chars_per_piece_token", "byte_share"), bands[lang]):
            v = m[c].to_numpy()
            mid = np.median(v[long])
            lo, hi = np.quantile((v - mid) * np.sqrt(m.n_tokens.to_numpy()), [0.001, 0.999]) * 1.5
            assert np.allclose(got, (mid, min(0, lo), max(0, hi)), rtol=1e-12, atol=1e-12)
        ent = m.entropy_share.to_numpy()[long]
        assert abs(bands[lang].entropy - (np.median(ent) - 1.5 * (np.median(ent) - np.quantile(ent, 0.001)))) < 1e-12
    again = {(r.doc_id, r.reason) for r in judged(fertility(docs), bands).collect()}
    assert again == {(r.doc_id, r.reason) for r in fertility(docs, bands=bands).collect()}
