"""Language identification with error-correcting output codes (operator 6).

Every language has a codeword of bits. One binary classifier per bit predicts it from hashed character
n-grams; decoding weighs the loss of each bit by how far its classifier can be trusted and takes the
nearest codeword. Two codewords at nearly the same distance make the answer ambiguous.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns

# Bounds of the training sample: documents of each language, and of all together. With many languages
# each has an equal share of the whole, one document at least.
SAMPLE_DOCS = 400
ALL_DOCS = 80_000
BUCKETS = 1 << 15
# Distances of the best two codewords closer than this are flagged.
AMBIGUOUS = 0.15
UNKNOWN = "und"
MADE = "lang_pred string, score double, ambiguous boolean"
# Odd multipliers of the n-gram hash, one per length.
MULTIPLIERS = {1: 0x9E3779B1, 2: 0x85EBCA77, 3: 0xC2B2AE3D}


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets + 1 x bits
    trust: np.ndarray  # per bit


def codewords(n: int) -> np.ndarray:
    """``n`` different words of -1 and 1, far apart: all splits for few languages, else random ones.

    Up to five languages every split in two is one bit (the exhaustive code). For more, of several
    seeded draws the one with the greatest least distance is taken.
    """
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if language and split >> (language - 1) & 1 else -1 for split in splits] for language in range(n)])
    bits, best, apart = 10 + 3 * int(np.ceil(np.log2(n))), None, -1
    for seed in range(40):
        draw = np.random.default_rng(seed).choice([-1, 1], (n, bits))
        least = least_distance(draw)
        if least > apart and (np.abs(draw.sum(0)) < n).all():
            best, apart = draw, least
    if best is None or apart < 1:
        width = int(np.ceil(np.log2(n)))
        own = np.array([[1 if i >> bit & 1 else -1 for bit in range(width)] for i in range(n)])
        best = np.hstack([own, draw])
    return best


def least_distance(codes: np.ndarray) -> int:
    """The least number of bits in which two words differ; a block of words at a time is compared with all."""
    n, bits = codes.shape
    signs, least = codes.astype(np.float32), bits
    for start in range(0, n, 1000):
        distance = (bits - signs[start : start + 1000] @ signs.T) / 2
        distance[np.arange(len(distance)), np.arange(start, start + len(distance))] = bits
        least = min(least, int(distance.min()))
    return least


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of one to three signs of the whole text, and their share of all n-grams.

    Letters are lower-cased, every other run of signs is one space.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ascii_other = (codes < 97) | ((codes > 122) & (codes < 170))
    codes = np.where(ascii_other, np.uint64(32), codes)
    codes = codes[~(ascii_other & np.r_[False, ascii_other[:-1]])]
    found = []
    for size, factor in MULTIPLIERS.items():
        if len(codes) < size:
            continue
        mixed = np.zeros(len(codes) - size + 1, np.uint64)
        for i in range(size):
            mixed = (mixed * np.uint64(0x100000001B3) + codes[i : len(codes) - size + 1 + i]) & np.uint64(0xFFFFFFFF)
        mixed = (mixed * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
        found.append((mixed >> np.uint64(17)).astype(np.int64))
    if not found:
        return np.zeros(0, int), np.zeros(0)
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    used = np.flatnonzero(counts)
    values = np.sqrt(counts[used])
    return used, values / np.sqrt((values**2).sum())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(texts: list[str], langs: list[str], rounds: int = 60, rate: float = 2.0, decay: float = 1e-5) -> Model:
    """Logistic classifiers for all bits by gradient steps on the whole sample."""
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS + 1, codes.shape[1]))
    if len(languages) < 2:
        return Model(languages, codes, weights, np.ones(codes.shape[1]))
    grams = [ngram_counts(text) for text in texts]
    rows = np.repeat(np.arange(len(grams)), [len(used) for used, _ in grams])
    columns = np.concatenate([used for used, _ in grams])
    values = np.concatenate([share for _, share in grams])
    order = np.argsort(columns, kind="stable")
    by_row = np.r_[0, np.cumsum([len(used) for used, _ in grams])]
    number = {language: i for i, language in enumerate(languages)}
    label = np.array([number[lang] for lang in langs])
    target = codes[label]
    # Every language weighs the same.
    share = (1.0 / np.bincount(label, minlength=len(languages)))[label][:, None] / len(languages)
    starts = np.flatnonzero(np.r_[True, np.diff(columns[order]) > 0]) if len(columns) else np.zeros(0, int)
    touched = columns[order][starts] if len(columns) else np.zeros(0, int)
    filled = np.flatnonzero(np.diff(by_row))

    def margins() -> np.ndarray:
        out = np.tile(weights[-1], (len(grams), 1))
        if len(values):
            out[filled] += np.add.reduceat(weights[columns] * values[:, None], by_row[:-1][filled], axis=0)
        return out

    speed = np.zeros_like(weights)
    for _ in range(rounds):
        pull = target / (1 + np.exp(np.clip(target * margins(), -30, 30))) * share
        up = -decay * weights
        if len(values):
            up[touched] += np.add.reduceat((pull[rows] * values[:, None])[order], starts, axis=0)
        up[-1] += pull.sum(0) * 0.1
        speed = 0.9 * speed + up
        weights += rate * speed * len(languages)
    right = ((margins() * target > 0) * share).sum(0)
    error = np.clip(1 - right, 1e-3, 0.5)
    trust = 0.5 * np.log((1 - error) / error)
    return Model(languages, codes, weights, trust / trust.sum() if trust.sum() > 0 else np.ones(len(trust)) / len(trust))


def identify(texts: list[str | None], model: Model) -> dict[str, list]:
    """The nearest codeword's language, the share of the loss it avoids, and whether the second is near."""
    out: dict[str, list] = {"lang_pred": [], "score": [], "ambiguous": []}
    for text in texts:
        if not text or not model.languages or not has_letter(text):
            answer = (UNKNOWN, 0.0, False)
        else:
            used, values = ngram_counts(text)
            margin = values @ model.weights[used] + model.weights[-1]
            # The logistic loss of every bit against every codeword, weighed by trust.
            loss = (np.logaddexp(0, -model.codes * margin) * model.trust).sum(1)
            likely = np.exp(-(loss - loss.min()))
            likely /= likely.sum()
            near = np.sort(loss)
            best = int(np.argmin(loss))
            answer = (model.languages[best], float(likely[best]), bool(len(near) > 1 and near[1] - near[0] < AMBIGUOUS))
        for name, value in zip(out, answer, strict=True):
            out[name].append(value)
    return out


def held_out_column(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text has remainder 0 by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Train on documents that are not held out and have text with a letter and a language.

    Of every language at most ``SAMPLE_DOCS`` are taken, or an equal share of ``ALL_DOCS`` if that is
    less, in the order of a hash of their id. Rows that repeat a chosen id are taken too, up to that share.
    """
    rows = docs.where(~held_out_column()).select("doc_id", "text", "lang").where("text is not null and lang is not null")
    rows = rows.where(F.length("text") > 0)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return train([], [])
    share = max(1, ALL_DOCS // len(counts))
    each = min(SAMPLE_DOCS, share)
    langs = docs.sparkSession.createDataFrame([tuple(row) for row in counts], "lang string, n bigint")
    # The choice is made on narrow rows. A language with many documents first keeps those with the least
    # hashes, well above the sample, so that no task ranks all documents of a language.
    light = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("rank")).join(F.broadcast(langs), "lang")
    part = F.pmod("rank", F.lit(1 << 30)) / (1 << 30)
    light = light.where(part * F.col("n") <= 4 * SAMPLE_DOCS)
    order = Window.partitionBy("lang").orderBy("rank", "doc_id")
    chosen = light.withColumn("place", F.row_number().over(order)).where(F.col("place") <= each)
    chosen = chosen.select(F.col("doc_id").alias("doc_key"), F.col("lang").alias("lang_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("doc_key")) & (F.col("lang") == F.col("lang_key"))
    sample = rows.join(F.broadcast(chosen), same, "left_semi").select("lang", "text", "doc_id")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    sample = sample.withColumn("place", F.row_number().over(order)).where(F.col("place") <= share)
    found = sorted((row["lang"], row["text"]) for row in sample.collect() if has_letter(row["text"]))
    return train([text for _, text in found], [lang for lang, _ in found])


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the columns of ``MADE`` for every document, from its whole text alone.

    ``lang_pred`` is ``und`` with score 0 for texts that are null or have no letter, and for all texts
    if nothing could be learned. Repeated rows are judged one by one; columns not named in ``keep`` are
    not read. Two equally near codewords give the language that sorts first, marked as ambiguous.
    """
    parts = (model.languages, model.codes, model.weights, model.trust)
    sent = docs.sparkSession.sparkContext.broadcast(parts)
    return add_columns(docs, text_col, lambda texts: identify(texts, Model(*sent.value)), MADE, keep)


def language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out and the prediction for every document."""
    model = fit(docs) if model is None else model
    rows = docs.select("doc_id", held_out_column().alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
