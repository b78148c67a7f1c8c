import itertools
import random

from helpers import ODD, odd_rows, prose
from tidemark.llm import decontaminate as dc

ITEMS = [prose(f"item{i}", n) for i, n in enumerate([4, 9, 15, 20, 40, 59])]


def brute(text, items):
    words = dc.tokens_of(text)
    found = set()
    for item_id, item in items:
        own = dc.tokens_of(item)
        size = min(len(own), dc.STRETCH)
        if len(own) < 4:
            continue
        for i in range(len(words) - size + 1):
            for j in range(len(own) - size + 1):
                if 100 * sum(words[i + k] == own[j + k] for k in range(size)) >= dc.PERCENT * size:
                    found.add(item_id)
    return found


def changed(text, rng, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "swap"
    return " ".join(words)


def test_leaks_are_those_of_brute_force(spark):
    rng = random.Random(2)
    texts = [prose(i, rng.randrange(10, 60)) for i in range(10)]
    for item in ITEMS:
        n = len(item.split())
        for part in (0, n // 10, n // 5, n // 4, n // 3):
            texts.append(f"{prose(part, 12)} {changed(item, rng, part)}! {prose(part + 1, 12)}")
        texts.append(item.upper().replace(" ", "%% "))
        texts.append(" ".join(item.split()[: n // 2]))
    rows = odd_rows(texts)[:-5] + odd_rows(texts)[-4:]
    docs = spark.createDataFrame(rows, ODD)
    items = [(i, item) for i, item in enumerate(ITEMS)] + [(90, None), (91, "a b"), (None, prose(1, 20)), (3, ITEMS[3])]
    benchmark = spark.createDataFrame([(*item, "x") for item in items], "item_id bigint, text string, doc_id string")
    found = dc.find_leaks(docs, benchmark)
    wanted = sorted(repr((row[0], item)) for row in rows for item in brute(row[1], [i for i in items if i[0] is not None and i[1]]))
    assert sorted(repr((row["doc_id"], row["item_id"])) for row in found.collect()) == wanted
    clean = dc.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    leaky = {repr(row[0]) for row in rows if brute(row[1], [i for i in items if i[0] is not None and i[1]])}
    assert clean.count() == sum(1 for row in rows if repr(row[0]) not in leaky)


def test_several_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{prose(i, 9)} {item}") for i, item in enumerate(ITEMS)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string")
    one = sorted(map(tuple, dc.find_leaks(docs, benchmark).collect()))
    monkeypatch.setattr(dc, "BLOCK_TOKENS", 100)
    assert sorted(map(tuple, dc.find_leaks(docs, benchmark).collect())) == one


def test_masks_meet_every_overlap():
    for n in range(4, 17):
        for gone in itertools.combinations(range(n), n - -(-4 * n // 5)):
            line = "".join("0" if i in gone else "1" for i in range(n))
            assert any(
                all(line[i + k] == "1" for k, sign in enumerate(mask) if sign == "1")
                for mask in dc.MASKS for i in range(n - len(mask) + 1)
            )


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], ODD), spark.createDataFrame([], "item_id bigint, text string")
    assert dc.find_leaks(docs, items).count() == 0
    assert dc.find_leaks(spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string"), items).count() == 0
    assert dc.without_leaks(docs, items).count() == 0


def leaks(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return sorted(tuple(row) for row in dc.find_leaks(docs, benchmark).collect())


def test_items_cut_off_by_the_edges_of_a_document(spark):
    words = ITEMS[2].split()
    texts = [" ".join(words[:14]), " ".join(words[3:]), "other " + " ".join(words[:12]), " ".join(words[:11]), " ".join(words[4:])]
    assert leaks(spark, texts, [ITEMS[2]]) == [(0, 0, 0, 0, 14, 14), (1, 0, 0, 3, 12, 12), (2, 0, 1, 0, 12, 12)]
    # Of an item that is little longer than a stretch four fifths can be less than one.
    words = prose("thirty", 30).split()
    texts = [" ".join(words[-24:]), " ".join(words[:24]), " ".join(words[:23])]
    assert leaks(spark, texts, [" ".join(words)]) == [(0, 0, 0, 6, 24, 24), (1, 0, 0, 0, 24, 24)]


def test_short_items_and_scripts_without_spaces(spark):
    items = ["Zebra quilt", "中国的首都是哪里", "กรุงเทพ", "xylophone"]
    texts = ["a zebra, quilt!", "zebra and quilt", "请问中国的首都在哪里?", "中国的天气", "ไปกรุงเทพวันนี้", "xylophones", "Xylophone_"]
    assert [row[:2] for row in leaks(spark, texts, items)] == [(0, 0), (2, 1), (4, 2), (6, 3)]


def test_an_item_of_a_word_or_two_drops_no_document(spark):
    docs = spark.createDataFrame([(1, "we saw the fox"), (2, "see the red fox run far")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the fox"), (3, "the red fox run")], "item_id bigint, text string")
    assert [row["doc_id"] for row in dc.without_leaks(docs, items).collect()] == [1]
    assert dc.without_leaks(docs, items, least=1).count() == 0
    assert dc.find_leaks(docs, items).count() == 4
