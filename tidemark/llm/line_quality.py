"""Quality rules by line labels (operator 4).

A linear-chain conditional random field labels the lines of a text as content or boilerplate;
Viterbi decoding finds the best sequence and the share of words in content lines decides whether
the document stays. The field is trained on a bounded sample of labelled documents: lines of a
document of good quality count as content, lines of a document of bad quality as boilerplate.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, computed

# Bounds of the training sample: labelled documents per quality class, and lines of each.
SAMPLE_DOCS = 600
SAMPLE_LINES = 120
SYMBOLS = re.compile(r"[#*$%&|<>]")
SYMBOL_BYTES = re.compile(rb"[#*$%&|<>]")
SYMBOL_WORDS = re.compile(rb"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")
SPACES = re.compile(r"[\x20\x09-\x0D]")
UPPER, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
OTHER_LETTERS = string.ascii_lowercase.encode() + bytes(range(128, 256))
# A document whose content lines hold at least this share of its words is kept.
CONTENT_SHARE = 0.5
BASE_WORDS = 50

MADE = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, content_words bigint, kept boolean"
)
FEATURES = (
    "one", "symbols per word", "words with a symbol inside", "upper-case share", "letter share", "digit share",
    "long line", "short line", "words repeated in line", "most frequent word", "earlier line", "mean word length", "marks"
)


@dataclass
class LineField:
    """Weights per label (0 boilerplate, 1 content) and the scores of label changes."""

    weights: np.ndarray
    moves: np.ndarray


def default_field() -> LineField:
    """The field used where no labelled document is at hand: symbols, capitals and repeats count against a line."""
    weights = np.zeros((2, len(FEATURES)))
    weights[1] = [2.0, -4.0, -2.0, -3.0, 1.0, -2.0, 0.2, 0.0, -1.5, -3.0, -1.0, 0.0, -1.5]
    return LineField(weights, np.array([[0.5, -0.5], [-0.5, 0.5]]))


def _bytes(text: str) -> bytes:
    # bytes.split() without arguments cuts at exactly the six white-space bytes \x20 and \x09-\x0D.
    return text.encode("utf-8", "surrogatepass")


def line_features(line: bytes, words: list[bytes], earlier: bool) -> list[float]:
    """Shares of byte kinds and word repeats of one line; bytes above 127 count as letters."""
    n, size = len(words), len(line)
    upper, lower, digits = (size - len(line.translate(None, kind)) for kind in (UPPER, OTHER_LETTERS, DIGITS))
    symbols = len(SYMBOL_BYTES.findall(line))
    counts = Counter(words)
    return [
        1.0,
        min(symbols / n, 3.0),
        len(SYMBOL_WORDS.findall(line)) / n if symbols else 0.0,
        upper / max(1, upper + lower),
        (upper + lower) / size,
        digits / size,
        min(1.0, math.log1p(n) / 6),
        1.0 if n < 3 else 0.0,
        1 - len(counts) / n,
        max(counts.values()) / n if n > 3 else 0.0,
        1.0 if earlier else 0.0,
        min(2.0, size / n / 10),
        min(1.0, line.count(b"!") / n),
    ]


def read_lines(text: str) -> tuple[list[list[float]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many of them repeat an earlier one."""
    features, sizes, seen, repeats = [], [], set(), 0
    for line in _bytes(text).split(b"\n"):
        words = line.split()
        if not words:
            continue
        earlier = line in seen
        seen.add(line)
        repeats += earlier
        features.append(line_features(line, words, earlier))
        sizes.append(len(words))
    return features, sizes, repeats


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    first: dict[tuple, int] = {}
    again = set()
    for window in windows:
        if first.setdefault(window, 1) == 1:
            first[window] = 2
        else:
            again.add(window)
    if not again:
        return 0
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if window in again:
            covered += start + 3 - max(end, start)
            end = start + 3
    return covered


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best label sequence; a tie goes to content."""
    (b_b, b_c), (c_b, c_c) = moves.tolist()
    back, bad, good = [], *scores[0].tolist()
    for to_bad, to_good in scores[1:].tolist():
        from_bad, from_good = (bad + b_b > good + c_b), (good + c_c < bad + b_c)
        bad, good = (
            to_bad + (bad + b_b if from_bad else good + c_b),
            to_good + (bad + b_c if from_good else good + c_c),
        )
        back.append((0 if from_bad else 1, 0 if from_good else 1))
    labels = [1 if good >= bad else 0]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def train_field(texts: list[str], good: list[int], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """Maximise the label likelihood of the sample by gradient steps over forward and backward sums."""
    docs, marks = [], []
    for text, quality in zip(texts, good, strict=True):
        features = read_lines(text)[0][:SAMPLE_LINES]
        if features:
            docs.append(np.array(features))
            marks.append(np.full(len(features), 1 if quality else 0))
    if not docs or len({int(mark) for row in marks for mark in row}) < 2:
        return default_field()
    longest = max(map(len, docs))
    x = np.zeros((len(docs), longest, len(FEATURES)))
    y, real = np.zeros((len(docs), longest), int), np.zeros((len(docs), longest), bool)
    for i, (features, mark) in enumerate(zip(docs, marks, strict=True)):
        x[i, : len(mark)], y[i, : len(mark)], real[i, : len(mark)] = features, mark, True
    # Both classes weigh the same, however rare one of them is.
    good_share = y[real].mean()
    weight = np.where(y.max(1) > 0, 0.5 / good_share, 0.5 / (1 - good_share))
    total = (weight[:, None] * real).sum()
    weights, moves = np.zeros((2, x.shape[2])), np.zeros((2, 2))
    steps = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    truth = np.eye(2)[y] * real[:, :, None]
    for turn in range(1, rounds + 1):
        scores = (x @ weights.T) * real[:, :, None]
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(*(ahead[:, t - 1, k, None] + moves[None, k] for k in (0, 1))) + scores[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = behind[:, t + 1] + scores[:, t + 1]
            step = np.logaddexp(*(after[:, k, None] + moves[None, :, k] for k in (0, 1)))
            behind[:, t] = np.where(real[:, t + 1, None], step, behind[:, t + 1])
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        each = np.exp(ahead + behind - norm[:, None, None]) * real[:, :, None]
        pair = np.exp(
            ahead[:, :-1, :, None] + moves + (scores + behind)[:, 1:, None, :] - norm[:, None, None, None]
        ) * real[:, 1:, None, None]
        seen_pair = truth[:, :-1, :, None] * truth[:, 1:, None, :]
        up_w = np.einsum("ntk,ntf,n->kf", truth - each, x, weight) / total - decay * weights
        up_m = np.einsum("ntij,n->ij", seen_pair - pair, weight) / total - decay * moves
        for at, (value, up) in enumerate(((weights, up_w), (moves, up_m))):
            mean, square = steps[2 * at], steps[2 * at + 1]
            mean += 0.1 * (up - mean)
            square += 0.01 * (up**2 - square)
            value += rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return LineField(weights, moves)


def judge(texts: list[str | None], field: LineField, share: float = CONTENT_SHARE) -> dict[str, list]:
    """The columns of ``MADE`` for texts; a null text has no words."""
    out: dict[str, list] = {name.split()[0]: [] for name in MADE.split(", ")}
    features, spans = [], []
    for text in texts:
        text = text or ""
        words = _bytes(text).split()
        lines, sizes, repeats = read_lines(text)
        spans.append((len(features), sizes))
        features += lines
        repeat_words = repeated_words(words)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - len(SPACES.findall(text)))
        out["n_symbols"].append(len(SYMBOLS.findall(text)))
        out["n_dup_lines"].append(repeats)
        out["n_repeat_words"].append(repeat_words)
        out["base_failed"].append(len(words) < BASE_WORDS or 100 * repeat_words > 50 * len(words))
    scores = np.array(features).reshape(-1, len(FEATURES)) @ field.weights.T
    for at, (start, sizes) in enumerate(spans):
        content = 0
        if sizes:
            labels = viterbi(scores[start : start + len(sizes)], field.moves)
            content = sum(size for size, label in zip(sizes, labels, strict=True) if label)
        out["content_words"].append(content)
        out["kept"].append(not out["base_failed"][at] and content >= share * out["n_words"][at])
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Train on at most ``SAMPLE_DOCS`` labelled documents of each quality, chosen by a hash of their id.

    Rows with a null id, text or quality are not used. Without labelled documents of both kinds the
    field is ``default_field()``.
    """
    marks = labels.select(F.col("doc_id").alias("mark_id"), F.col("quality").alias("mark")).dropna().distinct()
    chosen = None
    for quality in (0, 1):
        some = marks.where(F.col("mark") == quality).orderBy(F.xxhash64("mark_id"), "mark_id").limit(SAMPLE_DOCS)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("mark_id"), F.col(text_col).alias("mark_text")).dropna()
    sample = texts.join(F.broadcast(chosen), "mark_id").orderBy("mark_id", "mark_text", "mark").limit(2 * SAMPLE_DOCS)
    rows = sample.select("mark_text", "mark").collect()
    return train_field([row[0] for row in rows], [int(row[1]) for row in rows])


def line_quality(
    docs: DataFrame, field: LineField, keep: list[str], text_col: str = "text", share: float = CONTENT_SHARE
) -> DataFrame:
    """``keep`` and the columns of ``MADE`` for every document.

    Null and empty texts have no words, fail the base rules and are not kept. Repeated rows are judged
    one by one; other columns are neither read nor returned, so their names cannot clash. An empty
    table gives an empty result.
    """
    return add_columns(docs, text_col, lambda texts: judge(texts, field, share), MADE, keep)


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; see ``line_quality``."""
    return docs.where(computed(text_col, lambda texts: judge(texts, field)["kept"], "boolean"))
