import collections
import random
import re

import numpy as np

from helpers import ODD, odd_rows, prose
from tidemark.llm import components, jaccard


def brute(texts, words, percent):
    """Set sizes and group numbers, by comparing all pairs that share a shingle."""
    sets = []
    for text in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [len(s) for s in sets], group


def near_copies(seed, n_bases=6, each=25, size=60):
    rng = random.Random(seed)
    texts = []
    for base in range(n_bases):
        words = prose(f"{seed}{base}", rng.randrange(3, size)).split()
        for _ in range(each):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(40)}"
            texts.append("  ".join(copy).title() if rng.random() < 0.2 else " ".join(copy))
    return texts + ["one", "One", "one two", "a b c", "a B c", "b c"]


def check(spark, texts, words, percent):
    rows = odd_rows(texts)
    docs = spark.createDataFrame(rows, ODD)
    found = jaccard.near_groups(docs, words, percent)
    sizes, groups = brute([row[1] for row in rows], words, percent)
    least = collections.defaultdict(list)
    for row, group in zip(rows, groups, strict=True):
        least[group].append(row[0])
    wanted = []
    for row, size, group in zip(rows, sizes, groups, strict=True):
        ids = [i for i in least[group] if i is not None]
        wanted.append((row[0], size, min(ids) if size and ids else row[0]))
    got = [tuple(row) for row in found.select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))
    return docs, found


def test_groups_are_those_of_all_pairs(spark):
    check(spark, near_copies(1), 3, 90)
    check(spark, near_copies(2), 5, 80)


def test_second_round_alone_and_blocks_of_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 1)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 3)
    monkeypatch.setattr(jaccard, "LEAST_GROUP", {"low_0": 1, "low_1": 1})
    monkeypatch.setattr(jaccard, "BROADCAST_KEYS", 0)
    check(spark, near_copies(3, 3, 20), 3, 90)


def test_one_document_of_each_group_stays(spark):
    docs, found = check(spark, near_copies(4), 5, 80)
    kept = jaccard.one_of_each_group(docs, 5, 80)
    assert kept.columns == docs.columns
    groups = found.where("component is not null").select("component").distinct().count()
    alone = found.where("component is null").count()
    assert kept.count() == groups + alone
    ids = {row[0] for row in found.where("component is not null").select("component_id").collect()}
    assert ids <= {row[0] for row in kept.select("doc_id").collect()}


def test_divide_skip_finds_every_link():
    rng = np.random.default_rng(5)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(1, 40))) for _ in range(60)]
    sets += [np.sort(np.r_[base[:50], np.uint64(1000 + i)]) for i in range(20)] + [np.zeros(0, np.uint64)]
    for percent in (50, 80, 90):
        wanted = set()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                shared = len(np.intersect1d(a, b))
                if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                    wanted.add((j, i))
        assert {tuple(sorted(link)) for link in jaccard.divide_skip(sets, percent, all_links=True)} == wanted


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    rows = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(row["node"], row["root"]) for row in rows} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 140)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], ODD)
    assert jaccard.near_groups(docs).count() == 0
    assert jaccard.one_of_each_group(docs).count() == 0
