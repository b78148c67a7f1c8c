import re

from helpers import ODD, odd_rows
from tidemark.llm import pii

SAMPLES = [
    "mail ann.16@mail8.example.com, Ann.16@mail8.example.com", "card 4417 7442 8035 1546 or 4111111111111111 or 4111111111111112",
    "call +1 (058) 555-3468 or (030) 555-1234 or 202-555-0175", "ssn 078-05-1120 not 000-12-3456",
    "dates 2021-02-28, 2021-02-30, 31/12/1999, 1.5.2020 and 12.31.2020", "host 129.190.225.188 not 300.1.1.1",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432", "version 1.2.3 number 12345678901",
]


def kinds(text):
    return [(kind, text[start:end]) for start, end, kind in pii.find(text)]


def test_what_is_found():
    assert kinds(SAMPLES[0]) == [("email", "ann.16@mail8.example.com"), ("email", "Ann.16@mail8.example.com")]
    assert kinds(SAMPLES[1]) == [("card", "4111111111111111")]
    assert [kind for kind, _ in kinds(SAMPLES[2])] == ["phone"] * 3
    assert kinds(SAMPLES[3]) == [("ssn", "078-05-1120")]
    assert [value for _, value in kinds(SAMPLES[4])] == ["2021-02-28", "31/12/1999", "1.5.2020", "12.31.2020"]
    assert kinds(SAMPLES[5]) == [("ip", "129.190.225.188")]
    assert [kind for kind, _ in kinds(SAMPLES[6])] == ["iban", "iban"]
    assert kinds(SAMPLES[7]) == []


def test_pseudonyms_keep_the_format_and_come_back():
    for text in SAMPLES:
        made, spans = pii.pseudonyms(text)
        assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", made))) == re.sub(
            r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text))
        )
        assert [span[2] for span in pii.find(made)] == [span[2] for span in spans]
        if spans:
            assert made != text
        assert pii.pseudonyms(made, back=True)[0] == text
        assert pii.pseudonyms(text, b"another")[0] != made or not spans


def test_permutation_is_one_to_one():
    for left, right in ((3, 4), (10, 10), (7, 2)):
        made = [pii.permute(value, left, right, b"k", b"t") for value in range(left * right)]
        assert sorted(made) == list(range(left * right))
        assert [pii.permute(value, left, right, b"k", b"t", back=True) for value in made] == list(range(left * right))


def test_equal_values_stay_linked_and_edges(spark):
    docs = spark.createDataFrame(odd_rows([*SAMPLES, "again 129.190.225.188 here"]), ODD)
    rows = pii.pseudonymise(docs, ["doc_id", "kept"]).collect()
    assert len(rows) == docs.count()
    texts = {row["doc_id"]: row["text"] for row in rows if row["doc_id"] is not None}
    ip = pii.pseudonyms("129.190.225.188")[0]
    assert ip in texts[5] and ip in texts[8]
    assert texts[900] is None and texts[901] == ""
    assert all(row["kept"] == 1 for row in rows)
    assert pii.pseudonymise(spark.createDataFrame([], ODD), ["doc_id"]).count() == 0


def test_values_with_neighbours_in_their_match():
    for text, kind, value in (
        ("4111 1111 1111 1111 123", "card", "4111 1111 1111 1111"), ("4111111111111111 12/27", "card", "4111111111111111"),
        ("no 123 4111 1111 1111 1111.", "card", "4111 1111 1111 1111"), ("4111-1111-1111-1111-123", "card", "4111-1111-1111-1111"),
        ("BE68 5390 0754 7034 BIC", "iban", "BE68 5390 0754 7034"), ("BE68539007547034 USD 5", "iban", "BE68539007547034"),
        ("XX12 ABCD BE68 5390 0754 7034", "iban", "BE68 5390 0754 7034"),
    ):
        assert (kind, value) in kinds(text)
        made, spans = pii.pseudonyms(text)
        assert value not in made and pii.find(made) == spans


def test_values_with_neighbours_come_back():
    for code in range(300):
        for text in (f"4111 1111 1111 1111 {code:03d}", f"{code:03d} 4111 1111 1111 1111 12/27/2027", f"BE68539007547034 NO9386011117947 {code}"):
            made, spans = pii.pseudonyms(text, b"%d" % code)
            assert spans and pii.find(made) == spans
            assert pii.pseudonyms(made, b"%d" % code, back=True)[0] == text
