"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams, counted over all labelled training texts. A document is a
mixture of languages: expectation-maximisation fits the proportions, and a language joins the set only while the
gain in log-likelihood exceeds a penalty (half the log of the trigram count, once for each of the three bytes a
trigram overlaps). As the likelihood is concave in the proportions, a language whose gradient is not positive cannot
gain and is not tried.

A filter also asks whether the text is in these languages at all: per trigram it must gain at least half as much over
even odds as the texts learned from do on average, less what chance explains in so many trigrams (`Model.fits`).

Rules: a null text, or one without a letter, is `und` with score 0. With nothing to learn from every row is `und`.
Rows with null text or language are not learned from; nor are rows without doc_id, which count as held out.
Repeated rows count each time. Equal likelihoods go to the language that sorts first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import decode, documents_of, prepare

BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
EM_STEPS = 12
#: A text fits its languages if it gains this share of what they usually gain a trigram over even odds.
USUAL_GAIN = 0.5
#: Standard deviations by which a text may fall short of that by chance.
DEVIATIONS = 4.0
MIX = np.uint32(2654435761)  # odd multiplier that spreads trigrams over the buckets

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def trigram_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the folded byte trigrams of a whole text.

    Letters are folded to lower case (A-Z and the two-byte Latin capitals), other ASCII becomes a blank, and
    trigrams with two blanks side by side are skipped.
    """
    b = _FOLD[np.frombuffer(b" " + raw + b" ", np.uint8)]
    capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E)) + 1
    b[capital] += 0x20
    x, y, z = b[:-2].astype(np.uint32), b[1:-1].astype(np.uint32), b[2:].astype(np.uint32)
    good = ((x != 32) | (y != 32)) & ((y != 32) | (z != 32))
    h = ((x | y << 8 | z << 16)[good] * MIX) >> np.uint32(17)
    if len(h) < 4000:
        return np.unique(h, return_counts=True)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def has_letter(raw: bytes) -> bool:
    b = np.frombuffer(raw, np.uint8)
    return bool(((b | 32) - np.uint8(97) < 26).any()) or (bool((b > 127).any()) and any(map(str.isalpha, decode(raw))))


def _train(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            at, n = trigram_counts(raw)
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    """Languages and their trigram probabilities, one row per bucket."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0, keepdims=True)
        # Mean and deviation of a trigram's gain over even odds, in each language's own texts.
        gain, share = np.log(self.p * BUCKETS), counts / np.maximum(counts.sum(axis=0, keepdims=True), 1)
        self.usual = (share * gain).sum(axis=0)
        self.spread = np.sqrt(np.maximum((share * gain**2).sum(axis=0) - self.usual**2, 0))

    def fitted(self, raw: bytes) -> tuple[dict[int, float], float, int]:
        """Proportions of the chosen languages by number, the log-likelihood and the number of trigrams."""
        at, n = trigram_counts(raw)
        if not len(at) or not self.langs:
            return {}, 0.0, 0
        p, total = self.p[at], n.sum()
        fit = n @ np.log(p)
        chosen, share, best = [int(fit.argmax())], np.ones(1), fit.max()
        penalty = 1.5 * math.log(total + 1)
        while len(chosen) < len(self.langs):
            gradient = (n / (p[:, chosen] @ share)) @ p / total
            gradient[chosen] = 0
            new = int(gradient.argmax())
            if gradient[new] <= 1:
                break
            q, w = p[:, [*chosen, new]], np.append(share * 0.9, 0.1)
            for _ in range(EM_STEPS):
                w = w * ((n / (q @ w)) @ q) / total
            gained = n @ np.log(q @ w)
            if gained - best <= penalty:
                break
            chosen, share, best = [*chosen, new], w, gained
        return {c: float(s) for c, s in zip(chosen, share, strict=True)}, float(best), int(total)

    def mixture(self, raw: bytes) -> dict[str, float]:
        """Proportions of the chosen languages."""
        return {self.langs[c]: s for c, s in self.fitted(raw)[0].items()}

    def fits(self, shares: dict[int, float], best: float, total: int) -> bool:
        """Whether a text so fitted is in the learned languages. Neighbouring trigrams share bytes, so three of them
        count as one where chance is weighed."""
        usual = sum(s * self.usual[c] for c, s in shares.items())
        spread = max((self.spread[c] for c in shares), default=0.0)
        return best + total * math.log(BUCKETS) >= USUAL_GAIN * usual * total - DEVIATIONS * spread * math.sqrt(3 * total)

    def accepts(self, raw: bytes | None, least: float) -> bool:
        """Whether a text has a letter, a language with the share `least`, and fits its languages."""
        shares, best, total = self.fitted(raw) if raw and has_letter(raw) else ({}, 0.0, 0)
        return bool(shares) and max(shares.values()) >= least and self.fits(shares, best, total)

    def predict(self, raw: bytes | None) -> tuple[str, float, str]:
        """Main language, its share, and the set with shares as text."""
        found = self.mixture(raw) if raw and has_letter(raw) else {}
        if not found:
            return UNKNOWN, 0.0, ""
        top = min(found, key=lambda x: (-found[x], x))
        return top, min(1.0, found[top]), " ".join(f"{x}:{found[x]:.3f}" for x in sorted(found))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame) -> Model:
    """Count trigrams by language over all training rows. The driver receives one number per language and bucket."""
    prepare(docs.sparkSession)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.col("text").cast("binary").alias("text"))
    counts = rows.mapInArrow(_train, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    table[got.column("bucket").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return Model(langs, table)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the language set of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers

    def run(batches):
        for b in batches:
            found = [shared.value.predict(raw) for raw in b.column(1).to_pylist()]
            lang, score, langs = zip(*found, strict=True) if found else ((), (), ())
            cols = [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "lang_set"])

    found = documents_of(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double, lang_set string")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose main language has at least the share `least`; `und` rows go, and so do
    texts that fit none of the learned languages."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            good = [shared.value.accepts(raw, least) for raw in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
