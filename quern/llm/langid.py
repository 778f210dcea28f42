"""Operator 9: language identification in two levels.

A text becomes the root-scaled, length-normalised counts of its hashed byte trigrams. Linear support vector
machines decide in two steps: one for each pair of language families, then, inside the winning family,
one for each pair of its languages. In both steps the most votes win, and ties go to the larger summed margin.
The score is the product of the two steps' logistic margins.

The machines are fitted on a bounded sample: about ``per_language`` labelled texts of each language, chosen by a
hash of the key among the rows given for learning, and never more than twice that. Prediction reads the text only.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal answers;
without any labelled row everything is ``und``; if only one language is known, all texts with a letter get it; texts
are read whole, however long; votes and margins that tie go to the language that is first by code; an empty table
gives no rows; extra columns stay, but for those named like a new one or with two leading underscores, which go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import public, small_batches

#: Families of languages by code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}
UNKNOWN = "und"
PER_LANGUAGE = 300
BITS = 12
SIZE = 1 << BITS
LETTER = regex.compile(r"\p{L}")
# ASCII letters and all bytes of other characters stay; the rest is a blank.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
BLOCK = 1 << 20


def features(text: str) -> np.ndarray:
    raw = text.lower().encode().translate(PLAIN)
    counts = np.zeros(SIZE)
    for at in range(0, len(raw), BLOCK):
        b = np.frombuffer(raw, np.uint8)[max(0, at - 2) : at + BLOCK].astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
            code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            counts += np.bincount(code, minlength=SIZE)
    root = np.sqrt(counts)
    return (root / max(np.sqrt(counts.sum()), 1.0)).astype(np.float32)


@dataclass
class Svm:
    """A linear machine: positive margins are ``yes``."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


def fit_svm(x: np.ndarray, sign: np.ndarray, penalty: float = 10.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps; both classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    step = 1.0 / (1.0 + 2 * penalty * 2)  # rows have length sqrt(2) at most and the shares sum to 1
    w = look = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0.0, 1.0 - sign * (x @ look))
        grad = look - 2 * penalty * (x.T @ (share * sign * slack))
        new = look - step * grad
        look = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Model:
    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[frozenset, Svm] = field(default_factory=dict)

    def _choose(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = self.machines[frozenset((a, b))]
            margin = float(m.weights @ x + m.bias)
            votes[m.yes if margin >= 0 else m.no] += 1
            margins[m.yes] += margin
            margins[m.no] -= margin
            least[m.yes], least[m.no] = min(least[m.yes], margin), min(least[m.no], -margin)
        best = max(names, key=lambda n: (votes[n], margins[n]))
        return best, 1.0 / (1.0 + float(np.exp(-2.0 * least[best])))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self._choose(list(self.families), x)
        lang, surer = self._choose(self.families[family], x)
        return lang, sure * surer


def fit(x: np.ndarray, langs: list[str]) -> Model:
    where = {lang: name for name, members in FAMILIES.items() for lang in members}
    model, names = Model(), np.array(langs, object)
    for lang in sorted(set(langs)):
        model.families.setdefault(where.get(lang, f"only {lang}"), []).append(lang)
    family = np.array([where.get(n, f"only {n}") for n in langs], object)
    pairs = [(a, b, family) for a, b in combinations(model.families, 2)]
    pairs += [(a, b, names) for members in model.families.values() for a, b in combinations(members, 2)]
    for a, b, of in pairs:
        rows = (of == a) | (of == b)
        weights, bias = fit_svm(x[rows], np.where(of[rows] == a, 1.0, -1.0))
        model.machines[frozenset((a, b))] = Svm(a, b, weights, bias)
    return model


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the bounded sample; only its feature vectors (4 * 2**BITS bytes each) reach the driver."""
    small_batches(labelled.sparkSession)
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    grain = 1 << 30
    share = F.create_map(*[F.lit(v) for lang_, n in counts.items() for v in (lang_, int(grain * min(1.0, per_language / n)))])
    sample = usable.filter(F.pmod(F.xxhash64("key", "text"), F.lit(grain)) < share[F.col("lang")]).select("lang", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[bool(LETTER.search(t)) for t in batch["text"]]]
            yield pd.DataFrame({"lang": batch["lang"], "x": [features(t).tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(vectors, "lang string, x binary").limit(2 * per_language * len(counts)).collect()
    if not rows:
        return Model()
    rows.sort(key=lambda r: (r["lang"], r["x"]))  # the fit doesn't depend on where the rows came from
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Nothing is shuffled."""
    docs = public(docs, "lang_pred", "score")
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    return docs.withColumn("__p", predict(F.col(text))).withColumns({"lang_pred": F.col("__p")["lang_pred"], "score": F.col("__p")["score"]}).drop("__p")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
