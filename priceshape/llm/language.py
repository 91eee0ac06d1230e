"""Language of texts in two steps: the family, then the closely related languages within it.

Letter sequences of one to three are counted over the whole text into hashed columns. Softmax
regression predicts the family; within the family each pair of languages has a linear support vector
machine, and the language with most votes wins. The models are fitted on the driver from at most
``sample`` documents (a documented bound), evenly from every language; prediction runs where the
documents lie, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from priceshape.llm import linear
from priceshape.llm.common import col, query, slices, table
from priceshape.llm.tokenizing import once

#: Documents the models are fitted on, and the languages (the most frequent ones) they learn at most.
SAMPLE, LANGUAGES = 4_000, 64
#: Columns of a text, as a power of two.
BITS = 11
#: Characters that are counted at once; sequences across the cuts of longer texts are left out.
PIECE = 1 << 20
UNKNOWN = "und"

#: Families of language codes. Other languages are families of their own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne pa sd si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "semitic": "am ar he mt ti",
    "malayic": "id jv ms su",
    "dravidian": "kn ml ta te",
}


def family(lang: str, families: dict[str, str] = FAMILIES) -> str:
    """Family of a language code; what follows ``-`` or ``_`` in the code does not count."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in families.items() if code in codes.split()), lang)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray:
    """Hashed counts of the letter sequences of one to three; runs of other signs count as one mark.
    All zeros for NULL and for texts without a letter."""
    letters, total = once(_letters), np.zeros(1 << BITS, np.int64)
    for start in range(0, len(text or ""), PIECE):
        code = np.frombuffer(text[start:start + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = letters[code]
        if not letter.any():
            continue
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        code = np.where(letter, code, 0)[kept].astype(np.uint32)
        sequence = np.zeros(len(code), np.uint32)
        for n in range(min(3, len(code))):
            sequence = sequence[:len(code) - n] * np.uint32(0x01000193) + code[n:] + np.uint32(n)
            total += np.bincount(sequence * np.uint32(2654435769) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def features(texts: list[str | None]) -> np.ndarray:
    """Square roots of the shares, so rows of length 1 (0 without a letter)."""
    made = np.array([counts(t) for t in texts], np.float64).reshape(len(texts), 1 << BITS)
    return np.sqrt(made / np.maximum(made.sum(axis=1, keepdims=True), 1))


class Languages:
    """The fitted models."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES):
        self.names = sorted(set(langs))
        y = np.array([self.names.index(lang) for lang in langs], np.int64)
        of = [family(name, families) for name in self.names]
        self.families = sorted(set(of))
        self.members = [[i for i, name in enumerate(of) if name == f] for f in self.families]
        self.centre = x.mean(axis=0) if len(x) else np.zeros(1 << BITS)
        x = x - self.centre
        group = np.array([self.families.index(name) for name in of], np.int64)
        self.weights = linear.fit_softmax(x, group[y], len(self.families)) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.members:
            for a, b in itertools.combinations(members, 2):
                rows = (y == a) | (y == b)
                self.pairs[a, b] = linear.fit_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of every row.

        The score is the probability of the family times the mean logistic value of the winner's
        margins. Equal votes go to the greater sum of margins, then to the first name. Rows of zeros
        are ``und`` with score 0, as is everything where nothing was learnt.
        """
        langs, score = [UNKNOWN] * len(x), np.zeros(len(x))
        known = np.flatnonzero(x.any(axis=1))
        if not self.names or not len(known):
            return langs, score
        z = linear.with_one(x[known] - self.centre)
        chance = linear.softmax(z @ self.weights) if self.weights is not None else np.ones((len(known), 1))
        chosen = chance.argmax(axis=1)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(chosen == f)
            votes, margin, sure = (np.zeros((len(rows), len(members))) for _ in range(3))
            for (i, a), (j, b) in itertools.combinations(enumerate(members), 2):
                m = z[rows] @ self.pairs[a, b]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                for k, side in ((i, m), (j, -m)):
                    margin[:, k] += side
                    sure[:, k] += 1 / (1 + np.exp(-np.clip(side, -40, 40)))
            best = np.array([max(range(len(members)), key=lambda k, r=r: (votes[r, k], margin[r, k], -k))
                             for r in range(len(rows))], np.int64)
            for r, k in enumerate(best):
                langs[known[rows[r]]] = self.names[members[k]]
            score[known[rows]] = chance[rows, f] * sure[np.arange(len(rows)), best] / max(1, len(members) - 1) \
                if len(members) > 1 else chance[rows, f]
        return langs, score


def _bucket(key: str):
    return F.pmod(F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, families: dict[str, str] = FAMILIES,
          key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Models fitted on at most ``sample`` documents, evenly from the ``languages`` most frequent ones.

    Only rows whose crc32 of the key as text leaves a remainder other than 0 by 5 are learnt from, and
    only those with a language and a letter in the text. Rows are chosen by a seeded hash of key and
    text; repeated rows count each. Nothing but the text enters the models.
    """
    rows = docs.where(_bucket(key) != 0).select(
        col(lang).cast("string").alias("_lang"), col(text).alias("_text"),
        F.xxhash64(F.lit(11), col(key), col(text)).alias("_order"),
    ).where("_lang IS NOT NULL AND _text RLIKE '\\\\p{L}'")
    most = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).collect()
    if not most:
        return Languages(np.zeros((0, 1 << BITS)), [], families)
    each = max(1, sample // len(most))
    # Twice the wanted rows of each language by their hash, so that no task ever holds a language.
    share = F.create_map(*[F.lit(v) for r in most for v in (r["_lang"], min(1.0, 2 * each / r["count"] + 1e-6))])
    thin = rows.where(F.pmod(F.col("_order"), F.lit(1 << 30)) < share[F.col("_lang")] * (1 << 30))
    first = Window.partitionBy("_lang").orderBy("_order", F.crc32(F.col("_text").cast("binary")))
    chosen = thin.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).select("_lang", "_order", "_text")

    def made(batches):
        for batch in slices(batches):
            x = features(batch.column("_text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_lang"), batch.column("_order"), pa.array([r.tobytes() for r in x], pa.binary())],
                ["lang", "place", "x"])

    found = chosen.mapInArrow(made, "lang string, place long, x binary").orderBy("lang", "place", "x").toPandas()
    x = np.frombuffer(b"".join(found["x"]), np.float16).reshape(len(found), 1 << BITS).astype(np.float64)
    return Languages(x, list(found["lang"]), families)


def predict_languages(docs: DataFrame, model: Languages, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every document with ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    One row per input row, repeated rows included; NULL, empty and letterless texts are ``und`` with
    score 0. A NULL key counts as the empty text for ``held_out``. Other columns are left out.
    """
    rows = docs.select(col(key).alias("_id"), (_bucket(key) == 0).alias("_held"), col(text).alias("_text"))

    def made(batches):
        for batch in slices(batches):
            langs, score = model.predict(features(batch.column("_text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_held"), pa.array(langs, pa.string()), pa.array(score, pa.float64())],
                ["_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(made, f"_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", key)


@query("op11_language_hierarchy")
def op11(spark, sf_dir):
    """Predicted language of every document, held-out ones marked."""
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, train(docs))
