"""Language ID: forward sums against enumeration, held-out accuracy, awkward rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm import language as L
from quillon.llm.common import flat

PIECES = L.load_pieces()


def spell(word: bytes) -> list[tuple[int, int, int]]:
    out = []
    for i in range(len(word)):
        state = 0
        for j in range(i, len(word)):
            to = int(PIECES.base[state]) + word[j]
            if PIECES.check[to] != state:
                break
            state = to
            if PIECES.piece[state] >= 0:
                out.append((i, j + 1, int(PIECES.piece[state])))
    return out


def enumerate_sum(word: bytes, prob) -> float:
    edges = {}
    for a, j, p in spell(word):
        edges.setdefault(a, []).append((j, prob[p]))
    total = [0.0] * (len(word) + 1)
    total[len(word)] = 1.0
    for i in range(len(word) - 1, -1, -1):
        total[i] = sum(p * total[j] for j, p in edges[i])
    return total[0]


def some_prob(seed):
    prob = np.random.default_rng(seed).random(len(PIECES.size))
    return prob / prob.sum()


def test_vocabulary_is_whole():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=L.VOCABULARY)
    want = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    want = {w for w in want if b" " not in w[1:]} | {bytes([b]) for b in range(256)}
    assert len(PIECES.size) == len(want)
    for w in want:
        assert spell(w)[[j for i, j, _ in spell(w) if i == 0].index(len(w))][2] >= 0
    assert PIECES.size.max() == max(map(len, want))


def test_forward_against_sums_over_all_segmentations():
    prob = some_prob(5)
    texts = ["The THEORY of École", "l'été; x9y\t2024-01-02 https://a.b/c?d=e", "日本語 zz \x00\x01", "", "ab" * 9 + "日" * 7]
    words = L.distinct_words(*flat(pa.array(texts)))
    lat = L.lattice(words.data, words.begin, words.length, PIECES)
    got = L.log_sums(lat, L.scaled(prob[:, None], PIECES.size))[:, 0]
    spelt = [bytes(words.data[b : b + n]) for b, n in zip(words.begin, words.length)]
    assert np.allclose(got, [np.log(enumerate_sum(w, prob)) for w in spelt], rtol=1e-9)
    assert [spelt[w][1:].decode() for w in words.which] == " ".join(texts).split()
    assert {spelt[c]: spelt[w] for c, w in zip(words.capital, words.lower)} == {b" The": b" the", b" THEORY": b" theory", " École".encode(): " école".encode()}
    assert words.rows.tolist() == [0, 4, 8, 11, 11, 12]


def test_long_words_are_scored_whole():
    prob = some_prob(6)
    for text in ("ab" * 3000, "the" * 1000, "日本" * 700, "x1" * 900 + "theory" * 300):
        words = L.distinct_words(*flat(pa.array([text, "short"])))
        lat = L.lattice(words.data, words.begin, words.length, PIECES)
        got = L.log_sums(lat, L.scaled(np.stack([prob, prob[::-1]], 1), PIECES.size))
        for k, own in enumerate((prob, prob[::-1])):
            word = b" " + text.encode()
            alpha = np.full(len(word) + 1, -np.inf)
            alpha[0] = 0.0
            for i, j, p in sorted(spell(word), key=lambda e: e[1]):
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + np.log(own[p]))
            assert np.isclose(got[words.which[0], k], alpha[-1], rtol=1e-9)


def test_case_is_marginalised():
    prob = L.scaled(some_prob(7)[:, None], PIECES.size)
    words = L.distinct_words(*flat(pa.array(["THE the"])))
    each = L.word_log_probs(words, PIECES, prob)[words.which, 0]
    spelt = lambda w: np.log(enumerate_sum(w, prob[:, 0] / L.SCALE**PIECES.size))
    assert np.allclose(each, [np.logaddexp(spelt(b" THE") + np.log(1 - L.CASE), spelt(b" the") + np.log(L.CASE)), spelt(b" the")])


def test_likeness_against_loop():
    rng = np.random.default_rng(3)
    each, size, rows = -rng.random(40) * 9, rng.integers(1, 9, 40), np.array([0, 0, 7, 8, 40])
    got = L.likeness(each, size, rows)
    for r in range(4):
        left = half = size[rows[r] : rows[r + 1]].sum() / 2
        total = 0.0
        for rate, n in sorted(((each[i] / size[i], size[i]) for i in range(rows[r], rows[r + 1])), reverse=True):
            total += min(left, n) * rate
            left -= min(left, n)
        assert np.isclose(got[r], total / max(half, 1))


def test_fit_raises_likelihood():
    texts = pa.array(["the cat sat on the mat " * 20, "a cat and the hat " * 20])
    _, one = L.fit(texts, PIECES, rounds=1)
    _, four = L.fit(texts, PIECES, rounds=4)
    assert four.mean() > one.mean() > -4


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(docs.where("doc_id % 2 = 0"), docs=60)
    held = docs.where("doc_id % 2 = 1")
    rows = L.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) >= 0.97 * len(rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)


def test_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(docs, docs=20)
    rows = [(1, None, "en"), (2, "", None), (3, " 12 !!", "en"), (None, "the and of that there", "en"), (4, "the and of that there", "x"), (4, "the and of that there", "x"), (5, "q" * 200_000, "en"), (6, "ж щ ъ ыэ юя " * 30, None)]
    df = spark.createDataFrame([(*r, 1, "a", "b") for r in rows], "doc_id bigint, text string, lang string, accepted int, language string, margin string")
    got = L.identify(df, model).collect()
    assert len(got) == len(rows)
    assert [r.accepted for r in got] == [False, False, False, True, True, True, False, False]
    assert [r.language for r in got if r.doc_id == 4] == ["en", "en"]
    assert L.identify(df.limit(0), model).count() == 0
    assert not any(r.accepted for r in L.identify(df, None).collect())
    assert L.train(df.limit(0)) is None
    kept = L.keep_identified(docs.limit(100))
    assert kept.columns == docs.columns and kept.count() >= 98
    blind = docs.limit(50).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(L.keep_identified(blind).collect(), key=str) == sorted(blind.collect(), key=str)


def test_numbers_codes_and_capitals_do_not_count_against_a_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(docs)
    base = docs.where("lang = 'en' and n_chars > 500").orderBy("doc_id").first().text[:400]
    rows = [(1, base.upper()), (2, base + " 4734663219866878 40d78a45c418324758e099eb7cb89bc0f5fa9f62 " * 3), (3, base + "!!! " * 40), (4, FINNISH * 4), (5, "0123456789 " * 40)]
    got = {r.doc_id: r.accepted for r in L.identify(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}


FINNISH = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. "
POLISH = "Warszawa jest stolicą Polski i największym miastem kraju, położonym nad Wisłą w środkowej części. Każdy człowiek ma prawo do życia. "


def test_mislabelled_documents_do_not_open_the_floor(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    mixed = docs.where("lang = 'en'").orderBy("doc_id").first().text
    wrong = spark.createDataFrame([(-1, "fr", POLISH), (-2, "fr", mixed)], docs.schema)
    model = L.train(docs.unionByName(wrong), docs=10_000)
    asked = spark.createDataFrame([(1, FINNISH * 2)], "doc_id bigint, text string")
    assert not any(r.accepted for r in L.identify(asked, model).collect())
    assert L.identify(docs, model).where("accepted").count() >= 0.99 * docs.count()


def test_each_language_has_a_floor_of_its_own():
    near, far = np.linspace(-1.6, -1.4, 100), np.linspace(-2.6, -2.4, 100)
    assert L.floor_of(near) > L.floor_of(far) and L.floor_of(np.zeros(0)) is None
    assert abs(L.floor_of(np.append(near, [-5, -6])) - L.floor_of(near)) < 0.1
