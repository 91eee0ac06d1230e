"""Language ID: plain counts, plain votes, held-out accuracy, and rows that are odd."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from priceshape.llm import language, linear

SCHEMA = "doc_id long, text string, lang string, source string, score double, `a b.c` string"
SYLLABLES = {"en": "the ing er tion wh th ea ly", "de": "der sch ung ch keit ü ver ein", "fr": "le eau é oux tion que è la",
             "es": "el ción ñ que mente ado í la", "x-klingon": "tlh qa gh bIj ngan Qapla"}


def text(lang, rng, n=40):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, text(lang, rng, rng.randrange(5, 80)), lang, lang, 0.5, "x")
           for i, lang in enumerate(rng.choices(list(SYLLABLES), [9, 3, 3, 2, 1], k=900))]
    same = text("es", rng)
    out += [(2000 + i, same, "es", "s", 0.5, "x") for i in range(300)]
    return out


@pytest.fixture(scope="module")
def model(spark, rows):
    return language.train(spark.createDataFrame(rows, SCHEMA), sample=400)


def plain_counts(text):
    cleaned, out = [], np.zeros(1 << language.BITS, np.int64)
    for c in text.lower():
        if c.isalpha():
            cleaned.append(ord(c))
        elif cleaned and cleaned[-1]:
            cleaned.append(0)
    for n in (1, 2, 3):
        for i in range(len(cleaned) - n + 1):
            value = 0
            for k, c in enumerate(cleaned[i:i + n]):
                value = (value * 0x01000193 + c + k) % 2**32
            out[(value * 2654435769 % 2**32) >> (32 - language.BITS)] += 1
    return out


@pytest.mark.parametrize("text", ["Ab, ab! Éa", "x", "a1b2 c", "ß ẞ İ 中文字", "t" * 300 + " . " * 40 + "Ño"])
def test_counts_equal_plain_ones(text):
    assert (language.counts(text) == plain_counts(text)).all()


def test_leading_marks_are_no_sequence():
    assert (language.counts("  ..ab") == language.counts("ab")).all()
    assert not language.counts(None).any() and not language.counts("").any() and not language.counts("1 2.\n\t!").any()


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(language, "PIECE", 1000)
    text = "lorem ipsum " * 5000 + "zzzz"
    whole = language.counts(text).sum()
    monkeypatch.setattr(language, "PIECE", 1 << 20)
    assert 0 <= language.counts(text).sum() - whole <= 3 * 61 * 2


def test_families():
    assert language.family("EN-us") == language.family("de") == "germanic"
    assert language.family("pt_BR") == language.family("fr") == "romance" and language.family("x-klingon") == "x-klingon"


def test_votes_equal_a_plain_vote(model, rows):
    x = language.features([r[1] for r in rows[:200]])
    langs, scores = model.predict(x)
    for row, lang, score in zip(x - model.centre, langs, scores, strict=True):
        z = np.append(row, 1.0)
        e = [math.exp(v) for v in z @ model.weights]
        f = max(range(len(e)), key=lambda k: e[k])
        members = model.members[f]
        votes = dict.fromkeys(members, 0)
        sure = dict.fromkeys(members, 0.0)
        for a, b in itertools.combinations(members, 2):
            m = z @ model.pairs[a, b]
            votes[a if m >= 0 else b] += 1
            sure[a] += 1 / (1 + math.exp(-m))
            sure[b] += 1 / (1 + math.exp(m))
        best = max(members, key=lambda k: votes[k])
        assert model.names[best] == lang
        assert score == pytest.approx(e[f] / sum(e) * (sure[best] / (len(members) - 1) if len(members) > 1 else 1))
    assert set(model.families) == {"germanic", "romance", "x-klingon"} and len(model.pairs) == 2


def test_held_out_accuracy(spark, model, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.predict_languages(frame, model).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) and 0 <= got[r[0]].score <= 1
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)


def test_only_learning_rows_and_the_text_count(spark, rows, model):
    """Other languages on held-out rows and other sources change nothing."""
    other = [(r[0], r[1], "fr" if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[2], "z", 9.0, "y") for r in rows]
    again = language.train(spark.createDataFrame(other, SCHEMA).repartition(5), sample=400)
    assert again.names == model.names and np.array_equal(again.weights, model.weights)
    assert all(np.array_equal(again.pairs[p], model.pairs[p]) for p in model.pairs)


def test_odd_rows(spark, model):
    odd = [(1, None), (2, ""), (3, " 12 !? \n"), (None, "der ung schein"), (4, "der ung schein"), (4, "der ung schein"), (5, "x" * 3_000_000)]
    frame = spark.createDataFrame([(i, t, None, None, None, None) for i, t in odd], SCHEMA)
    got = language.predict_languages(frame, model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(odd)
    for r in got.collect():
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.names
    none = language.train(frame)  # no languages to learn from
    assert {(r.lang_pred, r.score) for r in language.predict_languages(frame, none).collect()} == {("und", 0.0)}
    assert language.predict_languages(frame.where("false"), model).count() == 0


def test_one_language_and_at_most_so_many(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    one = language.train(frame, languages=1, sample=50)
    assert one.names == ["en"]
    assert {(r.lang_pred, r.score) for r in language.predict_languages(frame.limit(20), one).collect()} == {("en", 1.0)}


def test_linear_models_part_what_can_be_parted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = np.where(x @ [1.0, -2, 0.5, 0, 3] > 0.3, 1.0, -1.0)
    w = linear.fit_svm(x, y, cost=1000.0, rounds=100)
    assert ((linear.with_one(x) @ w > 0) == (y > 0)).mean() > 0.98
    s = linear.fit_softmax(x, (y > 0).astype(int), 2, rounds=500)
    assert ((linear.with_one(x) @ s).argmax(axis=1) == (y > 0)).mean() > 0.97
