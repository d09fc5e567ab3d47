import math

import pytest
from brute import fold, ppm, unigram
from pyspark.sql import functions as F

from shardwright.llm import lang_id, queries
from shardwright.llm import ppm as model
from shardwright.llm.shared import fold as fold_col

ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "one two"), (4, "one"), (5, "Ärger MIT " * 5), (6, "x" * 300_000), (7, "the cat " * 60_000)]


def test_ppm_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    train = [r.text for r in rows if fold(r.doc_id, 10)]
    score, (total, base) = ppm(train, model.ORDER), unigram(train)
    got = {r.doc_id: r for r in queries.op5_lm_scores(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        n, known, b = base(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (fold(r.doc_id, 10) == 0, n, known, total)
        assert math.isclose(g.base_score, b, rel_tol=1e-9, abs_tol=1e-6)
        if len(r.text or "") < 2000:
            assert math.isclose(g.score, score(r.text), rel_tol=1e-9, abs_tol=1e-6)


def test_ppm_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "n") for i, t in ODD], "doc_id long, text string, score string")
    got = model.ppm_scores(docs, block_bytes=100_000).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert [r.n_tokens for r in got if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert model.ppm_scores(docs.limit(0)).count() == 0


def test_ppm_without_training(spark):
    docs = spark.createDataFrame([(i, "ab") for i in range(200) if fold(i, 10) == 0], "doc_id long, text string")
    got = model.ppm_scores(docs).collect()
    assert got and all(r.train_tokens == 0 and math.isclose(r.score, -3 * math.log10(256)) for r in got)


def test_path_probabilities_add_up(spark):
    rows = [(sum(b << 8 * (model.ORDER - i) for i, b in enumerate(x)), n) for x, n in (((1,) * model.ORDER + (2,), 3), ((1,) * model.ORDER + (3,), 1), ((4,) + (1,) * (model.ORDER - 1) + (5,), 2))]
    context = rows[0][0] - 2
    asked = {context + s: 0 for s in range(256)} | dict(rows)
    df = spark.createDataFrame(sorted(asked.items()), "key long, n long")
    got = {r.key: r.value for r in model.path_probabilities(df).collect()}
    assert math.isclose(sum(10 ** got[context + s] for s in range(256)), 1, rel_tol=1e-9)


def test_language_of_held_out_documents(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    got = queries.op1_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    got = got.where("lang is not null and text rlike '[a-z]'").select("held_out", "lang", "lang_pred", "score", "rejected", F.length("text").alias("n")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got) / len(got) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_kneser_ney_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate([("a", "banana bandana"), ("a", "cabana"), ("b", "xyzzy zyx"), ("b", "yz zy xx")])], "doc_id long, lang string, text string")
    m = lang_id.kneser_ney({x: _grams(docs, x) for x in ("a", "b")})
    letters = [c for c in "abncdxyz "] + ["q"]
    for ctx in ("ban", "xyz", "qqq", "  b"):
        g = [[ord(c) for c in ctx + x] for x in letters]
        import numpy as np

        p = np.exp(m._logp(np.array(g, np.uint32), lang_id.ORDER))
        assert np.allclose(p.sum(0), 1, atol=1e-4), (ctx, p.sum(0))


def _grams(docs, lang):
    import numpy as np

    s, row = lang_id.symbols([r.text for r in docs.where(F.col("lang") == lang).collect()])
    g = lang_id.grams(s, row)
    _, first, c = np.unique(lang_id.key(g), return_index=True, return_counts=True)
    return g[first], c


def test_language_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    learned = lang_id.fit(docs.where(fold_col(F.col("doc_id"), 4) != 2))
    odd = [(1, None), (2, ""), (3, "1234 -- %%"), (4, "Привет мир, как дела сегодня утром"), (5, "qxzvk wqkz jjxq zzkqv xqjw kkvzq wxq"), (None, "the and of that"), (6, "the and of that " * 40_000)]
    got = {r.doc_id: r for r in lang_id.predict(spark.createDataFrame([(i, t, 1) for i, t in odd], "doc_id long, text string, score int"), learned, "doc_id").collect()}
    assert len(got) == len(odd)
    for i in (1, 2, 3):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[4].rejected and got[5].rejected
    assert got[6].lang_pred == "en" and not got[6].rejected
    assert lang_id.predict(docs.limit(0), learned, "doc_id").count() == 0
    nothing = lang_id.fit(docs.limit(0))
    assert {r.lang_pred for r in lang_id.predict(docs.limit(5), nothing, "doc_id").collect()} == {"und"}


@pytest.mark.parametrize("text", ["", "ab", "É-x y"])
def test_symbols(text):
    s, row = lang_id.symbols([text, None, text])
    want = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    assert "".join(map(chr, s[row == 0])) == "".join(w + " " for w in want) == "".join(map(chr, s[row == 2]))


FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van, az emberek ésszel és lelkiismerettel bírván egymással szemben testvéri szellemben kell hogy viseltessenek",
    "code": "for (int i = 0; i < buf_len; ++i) { if (ptr->next == NULL) continue; memcpy(dst + off, src, sizeof(uint32_t)); idx <<= 2; }",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền, mọi con người đều được tạo hóa ban cho lý trí và lương tâm",
}


def test_foreign_texts_are_rejected_and_own_ones_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    learned = lang_id.fit(docs.where(fold_col(F.col("doc_id"), 4) != 2))
    texts = spark.createDataFrame([(x, t) for x, t in FOREIGN.items()], "doc_id string, text string")
    assert {r.doc_id: r.rejected for r in lang_id.predict(texts, learned, "doc_id").collect()} == dict.fromkeys(FOREIGN, True)
    held = docs.where(fold_col(F.col("doc_id"), 4) == 2).where(F.col("text").rlike("[a-z]"))
    got = lang_id.predict(held, learned, "lang").agg(F.count("*").alias("n"), F.count_if("rejected").alias("gone"), F.count_if(F.col("lang") != F.col("lang_pred")).alias("wrong")).first()
    assert got.n > 2000 and got.gone <= 0.002 * got.n and got.wrong <= 0.01 * got.n


def test_one_odd_label_does_not_open_the_gate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang", "text")
    noise = spark.createDataFrame([(10**6 + i, "en", t) for i, t in enumerate(FOREIGN.values())], "doc_id long, lang string, text string")
    learned = lang_id.fit(docs.unionByName(noise))
    texts = spark.createDataFrame([(1, "Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun perustuvaa erotusta")], "doc_id long, text string")
    assert lang_id.predict(texts, learned, "doc_id").first().rejected


def test_many_languages(spark):
    import random

    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:03}": ["".join(rng.choices(rng.sample(letters, 9), k=rng.randint(2, 7))) for _ in range(40)] for k in range(120)}
    rows = [(i * 120 + k, x, " ".join(rng.choices(w, k=25))) for k, (x, w) in enumerate(words.items()) for i in range(12)]
    learned = lang_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(learned.languages) == 120 and sum(len(a) for m in learned.models for a in m.keys) < 120 * 2000
    fresh = spark.createDataFrame([(x, " ".join(rng.choices(w, k=25))) for x, w in words.items()], "doc_id string, text string")
    assert all(r.doc_id == r.lang_pred for r in lang_id.predict(fresh, learned, "doc_id").collect())
