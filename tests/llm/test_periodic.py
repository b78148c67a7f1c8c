import hashlib
import random
import re
import time
import zlib

from helpers import ODD, odd_rows, prose
from tidemark.llm import periodic


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute(words):
    """Every maximal stretch of every period, kept where no smaller period fits the whole of it."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if all(any(stretch[k] != stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found)


def kept(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return [word for i, word in enumerate(words) if i not in gone]


def strings(seed, count):
    """Texts over few words, random ones and such made of repeated, nested and glued pieces."""
    rng = random.Random(seed)
    for _ in range(count):
        pieces = []
        for _ in range(rng.randrange(1, 6)):
            piece = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 9))]
            if rng.random() < 0.5:
                piece = piece * rng.randrange(2, 7) + [rng.choice("abc")]
            pieces += piece * rng.randrange(1, 7)
            pieces += piece[: rng.randrange(len(piece) + 1)]
        yield pieces


def test_runs_against_brute_force(monkeypatch):
    texts = list(strings(1, 700)) + [[], ["a"], ["a"] * 5, ["a"] * 6, list("ab" * 4), list("ab" * 3 + "a"), list("abc" * 4)]
    wanted = [brute(words) for words in texts]
    assert sum(len(runs) > 1 for runs in wanted) > 100
    assert periodic.find_runs(texts) == wanted
    # Neither the texts beside it nor their number changes what a text has.
    monkeypatch.setattr(periodic, "GROUP_WORDS", 1)
    assert periodic.find_runs(texts) == wanted
    for words, runs in zip(texts, wanted, strict=True):
        assert periodic.collapsed(words, runs) == kept(words, runs)


def test_digests_and_edges(spark):
    texts = [prose(1, 300), "la " * 50, prose(2, 40) + " and so on" * 9, "x y\nx\ty  x y x y", " ".join(["p"] * 5), prose(3, 9) * 5]
    rows = odd_rows(texts + [prose(i, 60 + i) for i in range(10, 90)])
    docs = periodic.with_planted_runs(spark.createDataFrame(rows, ODD))
    assert docs.columns == spark.createDataFrame(rows, ODD).columns
    found = sorted(map(tuple, periodic.run_digests(docs).collect()), key=repr)
    wanted = []
    for row in rows:
        words = planted(row[0], row[1])
        runs = brute(words) if len(words) < 2000 else periodic.find_runs([words])[0]
        best = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        text = " ".join(kept(words, runs))
        wanted.append((row[0], len(runs), *told, *(hashlib.sha256(one.encode()).hexdigest() for one in (lines, text))))
    assert found == sorted(wanted, key=repr)
    assert sum(row[1] > 0 for row in found) > 8
    assert periodic.run_digests(spark.createDataFrame([], ODD)).count() == 0


def test_general_form_returns_runs_and_text(spark):
    docs = spark.createDataFrame([(1, "go a b a b a b a b stop"), (2, None)], "doc_id bigint, text string")
    one, two = periodic.periodic_runs(docs, ["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(run) for run in one["runs"]] == [(1, 8, 2)] and one["collapsed"] == "go a b stop"
    assert (two["n_words"], two["runs"], two["collapsed"]) == (0, [], "")


def test_long_texts_take_little_time():
    began = time.time()
    piece = [str(i % 977) for i in range(40_000)]
    texts = [["a"] * 300_000, ["a", "b"] * 150_000, piece * 8, ["a"] * 6 + ["b"] * 6, list("aabab" * 60_000)]
    runs = periodic.find_runs(texts)
    assert runs[0] == [(0, 300_000, 1)] and runs[1] == [(0, 300_000, 2)]
    assert runs[2][0] == (0, 320_000, 40_000) or (0, 320_000, 40_000) in runs[2]
    assert runs[3] == [(0, 6, 1), (6, 6, 1)] and (0, 300_000, 5) in runs[4]
    assert time.time() - began < 40
