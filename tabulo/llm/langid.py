"""Language identification (operator 6): nearest centroid over TF-IDF vectors of character n-grams.

A text is lower-cased and its UTF-8 bytes are counted as runs of one to four, hashed into DIMENSIONS
buckets; the vector is sqrt(count) * idf, normalised.  Every language has CENTROIDS centroids.  A text
takes the language of the centroid of the highest cosine; its score is that cosine.

The cosine of a short text is as low as that of a long one of a script that was never learned, so rejection
goes by the text's familiarity: the mean over its n-grams (weighted by sqrt(count)) of the log of their share in
the language that knows them best, against an even share.  A text is rejected when it lies more than SLACK
under the lowest REJECT_SHARE of the training rows of its language and richness, or when it has no letter.
Richness is the bit length of the number of its different n-grams; unlike the characters it does not grow when a
text repeats itself.  A class of under THIN rows is joined by its neighbours, step by step, then by those of all
languages; only with under LEAST training rows in all is nothing rejected for its distance.

Fitting: document frequencies, one reassignment of the centroids (and the languages' shares) and the
histograms for the rejection cover all training rows, each as one pass whose tasks add up fixed-size arrays;
only the starting centroids come from a bounded sample (SAMPLE texts of a language, those with the lowest hash
of their id).  What reaches the driver is bounded by DIMENSIONS, the number of languages and SAMPLE.

Edge cases: rows whose text or language is null are not learned from; a null or empty text, or one
without letters, is `und` with score 0 and rejected; without any training row every text is; equal cosines
go to the alphabetically first language; repeated rows count as often as they occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, take_worker

DIMENSIONS = 4096
CENTROIDS = 3
SAMPLE = 300
REJECT_SHARE = 0.005
SLACK = 0.1
THIN, LEAST = 100, 30
#: weight of an even share beside a language's own, so that no log is unbounded
EVEN = 0.1
RICHNESS = DIMENSIONS.bit_length() + 1
#: bins of familiarity
STEP = 0.01
LOWEST = np.log(EVEN / (1 + EVEN))
BINS = int((np.log(DIMENSIONS) - LOWEST) / STEP) + 2
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    total, run = np.zeros(DIMENSIONS, np.int64), np.zeros(len(a), np.uint32)
    for n in range(1, 5):
        if len(a) < n:
            break
        run = run[:len(a) - n + 1] * np.uint32(0x01000193) ^ (a[n - 1:] + np.uint32(n << 9))
        spread = run * np.uint32(0x9E3779B1)
        total += np.bincount(spread >> np.uint32(32 - 12), minlength=DIMENSIONS)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        out[i] = np.sqrt(counts(t)) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def richness(x: np.ndarray) -> np.ndarray:
    """Bit length of the number of different n-grams of each vector."""
    return np.frexp((x > 0).sum(axis=1))[1].astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    known: np.ndarray  # log of each n-gram's share in each language, against an even share
    floor: np.ndarray  # by language and richness: the lowest familiarity that is not rejected

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of at most a few hundred texts: number of the language, cosine, familiarity, richness."""
        x = vectors(texts, self.idf)
        cosine = x @ self.centroids.T
        best = cosine.argmax(axis=1)
        n_grams = x / self.idf  # sqrt(count), but for a factor a text
        familiar = (n_grams @ self.known.T).max(axis=1) / np.maximum(n_grams.sum(axis=1), 1e-12)
        return self.owner[best], np.clip(cosine[np.arange(len(texts)), best], 0, 1), familiar, richness(x)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, rejected."""
        lang, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), score, rejected
        for at in range(0, len(texts), 256):
            number, cosine, familiar, rich = self.measured(texts[at:at + 256])
            lang += [self.languages[i] for i in number]
            score[at:at + 256], rejected[at:at + 256] = cosine, familiar < self.floor[number, rich]
        return lang, score, rejected


def floors(rows: np.ndarray) -> np.ndarray:
    """By language and richness, from the number of rows of each language, richness and bin of familiarity."""
    out = np.full(rows.shape[:2], -np.inf)
    if rows.sum() < LEAST:
        return out
    for lang, rich in np.ndindex(*out.shape):
        for some in (rows[lang], rows.sum(axis=0)):  # all languages when this one has too few rows
            reach = 0
            while (near := some[max(0, rich - reach):rich + reach + 1].sum(axis=0)).sum() < THIN and reach < RICHNESS:
                reach += 1
            if near.sum() >= THIN:
                break
        lowest = np.argmax(near.cumsum() > REJECT_SHARE * near.sum())
        out[lang, rich] = LOWEST + STEP * lowest - SLACK
    return out


def _add_up(df: DataFrame, fold, width: int, groups: str = "g int") -> dict[int, np.ndarray]:
    """fold(batches) gives {group: array of `width` numbers} for a task; the sums over all tasks."""
    def task(batches):
        take_worker("langid")
        for g, values in fold(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([values.tolist()], pa.list_(pa.float64()))], names=["g", "v"])

    sums = df.mapInArrow(task, f"{groups}, v array<double>").select("g", F.posexplode("v").alias("i", "x")).where("x <> 0")
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("g", "i").agg(F.sum("x").alias("x")).collect():  # groups x width rows at most
        out.setdefault(r.g, np.zeros(width))[r.i] = r.x
    return out


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Deterministic: starts at the mean, then at the row farthest from what is chosen."""
    mean = x.mean(axis=0)
    centers = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.argmin((x @ np.array(centers).T).max(axis=1))])
    centers = np.array(centers)
    for _ in range(rounds):
        near = (x @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (near == c).any():
                m = x[near == c].mean(axis=0)
                centers[c] = m / max(np.linalg.norm(m), 1e-12)
    return centers


def fit(training: DataFrame, text: str = "text", lang: str = "lang", id_: str = "doc_id") -> Model:
    """training: rows to learn from (their text, language and, for the sample, id)."""
    rows = training.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(id_)).alias("h"))
    rows = rows.where("t IS NOT NULL AND l IS NOT NULL")
    languages = sorted(r.l for r in rows.select("l").distinct().collect())
    if not languages:
        return Model([], np.zeros(0, int), np.zeros((0, DIMENSIONS)), np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros((0, RICHNESS)))
    number = {x: i for i, x in enumerate(languages)}

    def frequencies(batches):
        total = np.zeros(DIMENSIONS + 1)
        for b in batches:
            for t in b.column(0).to_pylist():
                total[:-1] += counts(t) > 0
                total[-1] += 1
        return {0: total}

    df = _add_up(rows.select("t"), frequencies, DIMENSIONS + 1)[0]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 0.1

    # the sample: narrow rows are ranked first, then only the chosen texts are read
    chosen = rows.select("l", "h").distinct().selectExpr("l", "h", "row_number() OVER (PARTITION BY l ORDER BY h) AS n").where(F.col("n") <= SAMPLE)
    picked = rows.join(F.broadcast(chosen.select("l", "h")), ["l", "h"]).dropDuplicates(["l", "h"])  # SAMPLE a language

    @F.arrow_udf("array<float>")
    def vector(texts: pa.Array) -> pa.Array:
        take_worker("langid")
        return pa.array([v.tolist() for v in vectors(texts.to_pylist(), idf)], pa.list_(pa.float32()))

    sample: dict[str, list] = {}
    for r in picked.select("l", "h", vector("t").alias("v")).sort("l", "h").collect():
        sample.setdefault(r.l, []).append(r.v)
    started = [_spherical_kmeans(np.array(sample[x], np.float32), CENTROIDS) for x in languages]
    owner = np.repeat(np.arange(len(languages)), [len(c) for c in started])
    centers = np.concatenate(started).astype(np.float32)

    def per_batch(batches):
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                yield texts[at:at + 256], np.array([number[x] for x in langs[at:at + 256]])

    def reassigned(batches):
        sums = {}
        for texts, langs in per_batch(batches):
            x = vectors(texts, idf)
            cosine = x @ centers.T
            cosine[owner[None, :] != langs[:, None]] = -1
            for c, v in zip(cosine.argmax(axis=1).tolist(), x):
                sums[c] = sums[c] + v if c in sums else v.astype(np.float64)
        return sums

    shares = np.zeros((len(languages), DIMENSIONS))
    for c, total in _add_up(rows.select("t", "l"), reassigned, DIMENSIONS).items():
        centers[c] = total / max(np.linalg.norm(total), 1e-12)
        shares[owner[c]] += total / idf
    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)
    known = np.log((shares * DIMENSIONS + EVEN) / (1 + EVEN)).astype(np.float32)
    model = Model(languages, owner, centers, idf, known, np.zeros((len(languages), RICHNESS)))

    def spreads(batches):
        found = {}
        for texts, _ in per_batch(batches):
            for lang, _, familiar, rich in zip(*model.measured(texts)):
                found.setdefault(int(lang), np.zeros((RICHNESS, BINS)))[rich, int((familiar - LOWEST) / STEP)] += 1
        return {g: v.ravel() for g, v in found.items()}

    histograms = np.zeros((len(languages), RICHNESS, BINS))
    for g, v in _add_up(rows.select("t", "l"), spreads, RICHNESS * BINS).items():
        histograms[g] = v.reshape(RICHNESS, BINS)
    model.floor = floors(histograms)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected (columns of these names are replaced)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x centroids

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predicted(texts: pa.Array) -> pa.Array:
        take_worker("langid")
        lang, score, rejected = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["lang", "score", "rejected"])

    p, has = fresh(docs, "_predicted"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn(p, predicted(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return out.withColumns({
        "lang_pred": F.when(has, F.col(p)["lang"]).otherwise(UNKNOWN),
        "score": F.when(has, F.col(p)["score"]).otherwise(F.lit(0.0)),
        "rejected": F.when(has, F.col(p)["rejected"]).otherwise(F.lit(True)),
    }).drop(p)


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the rejected ones; all columns as they are."""
    t = fresh(docs, "_text")
    known = identify(docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias(t)), model, t).where(~F.col("rejected"))
    return known.select("row.*")
