"""Documents that meet the edges every operator must take: nulls, empty and long texts, repeats, odd columns."""

import random

ODD = "doc_id bigint, text string, ids int, n_words string, text_key int, component string, kept int, spans int, copies int"
PROSE = (
    "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak and talk about the rain "
    "that fell on hills beyond quiet rivers near small towns where people sell bread wool honey salt and paper"
).split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "", "s", "ed", ","]) for _ in range(n))


def odd_rows(texts):
    rows = [(i, text) for i, text in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "x"), (904, "é" * 3000), (905, prose(7, 20_000))]
    rows += [(1, texts[1]), (1, texts[1]), (None, texts[0]), (None, None)]
    return [(i, text, 5, "w", None, "c", 1, 2, 3) for i, text in rows]
