import random

import numpy as np

from helpers import ODD, odd_rows
from tidemark.llm import language

SOUNDS = {"aa": "ka to mi ru se", "bb": "sch ung ein ver ten", "cc": "eau oin que les ais", "dd": "ing the ous ly th", "ee": "ów cz rz ą ę", "ff": "ij oe aan een ver"}


def text_in(lang, seed, n=40):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SOUNDS[lang].split(), k=rng.randrange(1, 4))) for _ in range(n))


def docs_of(spark, langs, each=60):
    rows = [(i, text_in(langs[i % len(langs)], i), langs[i % len(langs)], "s") for i in range(each * len(langs))]
    rows += [(5000, None, "aa", "s"), (5001, "12 -- 34!", "aa", "s"), (5002, text_in("bb", 1), None, "s"), (None, text_in("aa", 2), "aa", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_held_out_languages_are_found(spark):
    for langs in (["aa", "bb"], list(SOUNDS)):
        docs = docs_of(spark, langs)
        rows = language.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
        assert all(row["held_out"] == language.is_held_out(row["doc_id"]) for row in rows)
        judged = [row for row in rows if row["held_out"] and row["lang_pred"] != "und" and row["lang"]]
        assert np.mean([row["lang_pred"] == row["lang"] for row in judged]) > 0.95
        by_id = {row["doc_id"]: row for row in rows}
        assert by_id[5000]["lang_pred"] == by_id[5001]["lang_pred"] == "und"
        assert by_id[5002]["lang_pred"] == "bb"
        assert all(0 <= row["score"] <= 1 for row in rows)


def test_language_and_source_are_no_input(spark):
    docs = docs_of(spark, ["aa", "bb"])
    model = language.fit(docs)
    swapped = docs.selectExpr("doc_id + 7 as doc_id", "text", "'zz' as lang", "'other' as source")
    first, second = (
        sorted((row["text"] or "", row["lang_pred"], row["score"]) for row in language.predict(rows, model, ["text"]).collect())
        for rows in (docs, swapped)
    )
    assert first == second


def test_codewords_are_far_apart():
    for n in (1, 2, 3, 5, 6, 20, 150):
        codes = language.codewords(n)
        assert codes.shape[0] == n and len({tuple(code) for code in codes.tolist()}) == n
        if n > 2:
            assert min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_a_tie_is_ambiguous_and_edges(spark):
    model = language.train(["ab", "ab"], ["x", "y"])
    found = language.identify(["ab", None, ""], model)
    assert found["ambiguous"] == [True, False, False] and found["lang_pred"] == ["x", "und", "und"]
    rows = language.predict(spark.createDataFrame(odd_rows(["ab", "cd"]), ODD), model, ["doc_id", "kept"])
    assert rows.count() == 12
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert language.language(empty).count() == 0


def test_no_language_is_left_out(spark):
    # More than two hundred, each with letters of its own; the last ones have the fewest documents.
    ids = [i for i in range(3000) if not language.is_held_out(i)]
    rows = []
    for k in range(230):
        own = "".join(chr(0x4E00 + 5 * k + i) for i in range(5))
        rows += [(ids.pop(), " ".join(own[j % 5 :] + own for j in range(4)), f"l{k:03d}") for _ in range(3 if k < 200 else 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == [f"l{k:03d}" for k in range(230)]
    found = language.identify([row[1] for row in rows], model)["lang_pred"]
    assert np.mean([lang == row[2] for lang, row in zip(found, rows)]) > 0.95


def test_a_repeated_document_leaves_room_for_other_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_DOCS", 20)
    kept = [i for i in range(100) if not language.is_held_out(i)]
    rows = [(kept[0], text_in("aa", 1), "aa")] * 200 + [(i, text_in("bb", i), "bb") for i in kept[1:4]]
    assert language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).languages == ["aa", "bb"]
