"""Format-preserving pseudonyms for personal data (operator 3).

Numbers and dates that pass their validation are permuted within their own format by a keyed Feistel
network: digits stay digits, separators stay, check digits are made to hold again. A value always gets
the same pseudonym under one key, so it stays linked across documents, and the key gives it back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from tidemark.llm.common import add_columns

ROUNDS = 8
KEY = b"tidemark"
# Kinds in the order in which they claim text; a later kind does not touch what an earlier one took.
KINDS = ("email", "iban", "card", "date", "ip", "ssn", "phone")
MADE = "n_email bigint, n_iban bigint, n_card bigint, n_date bigint, n_ip bigint, n_ssn bigint, n_phone bigint, spans string"
# Dates of this range are permuted among each other, both ends included.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
# Signs on either side of a value that can decide how it is read; more than the longest card or IBAN.
NEAR = 64

# The formats.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])")
DATE = re.compile(r"(?<![\d.\-/])(?:(\d{4})([-/.])(\d{1,2})\2(\d{1,2})|(\d{1,2})([-/.])(\d{1,2})\6(\d{4}))(?![\d\-/]|\.\d)")
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")
GROUP = re.compile(r"[A-Z0-9]+")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(
    r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])"
)


def _round_value(key: bytes, tag: bytes, turn: int, value: int, width: int) -> int:
    size = (width.bit_length() + 7) // 8 + 8
    text = b"%b|%d|%d|%d" % (tag, turn, value, width)
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=min(64, size)).digest(), "big") % width


def permute(value: int, left: int, right: int, key: bytes, tag: bytes, back: bool = False) -> int:
    """A keyed permutation of the numbers below ``left * right``; ``back`` undoes it.

    The number is two halves, one below each bound; rounds add a keyed hash of one half to the other.
    """
    a, b = divmod(value, right)
    turns = range(ROUNDS)
    if back:
        for turn in reversed(turns):
            if turn % 2 == 0:
                a = (a - _round_value(key, tag, turn, b, left)) % left
            else:
                b = (b - _round_value(key, tag, turn, a, right)) % right
    else:
        for turn in turns:
            if turn % 2 == 0:
                a = (a + _round_value(key, tag, turn, b, left)) % left
            else:
                b = (b + _round_value(key, tag, turn, a, right)) % right
    return a * right + b


def permute_within(value: int, size: int, fits: Callable[[int], bool], key: bytes, tag: bytes, back: bool) -> int:
    """The permutation limited to the numbers below ``size`` that fit: it is walked until one does."""
    right = max(2, int(size**0.5))
    left = -(-size // right)
    while True:
        value = permute(value, left, right, key, tag, back)
        if value < size and fits(value):
            return value


def _digits(text: str, key: bytes, tag: bytes, back: bool, fits: Callable[[str], bool] = lambda _: True) -> str:
    """Digits permuted among the digit strings of their length that fit."""
    n = len(text)
    if n == 0:
        return text
    made = permute_within(int(text), 10**n, lambda x: fits(str(x).zfill(n)), key, tag + b"%d" % n, back)
    return str(made).zfill(n)


def _refill(form: str, signs: str, wanted: Callable[[str], bool] = str.isdigit) -> str:
    """``form`` with its wanted signs replaced in order."""
    rest = iter(signs)
    return "".join(next(rest) if wanted(sign) else sign for sign in form)


def luhn_sum(digits: str) -> int:
    total = 0
    for i, sign in enumerate(reversed(digits)):
        value = int(sign) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn_sum(digits) == 0 and len(set(digits)) > 1


def _card(text: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not is_card(digits):
        return None

    def with_check(body: str) -> str:
        return body + str(-luhn_sum(body + "0") % 10)

    body = _digits(digits[:-1], key, b"card", back, lambda x: len(set(with_check(x))) > 1)
    return _refill(text, with_check(body))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(sign, 36)) for sign in text[4:] + text[:4])) % 97


def _iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = plain[4:]
    digits = _digits("".join(filter(str.isdigit, body)), key, b"iban" + plain[:2].encode(), back)
    body = _refill(body, digits)
    letters = "".join(filter(str.isalpha, body))
    if letters:
        value = sum((ord(sign) - 65) * 26**i for i, sign in enumerate(letters))
        value = permute_within(value, 26 ** len(letters), lambda _: True, key, b"iban-letters", back)
        body = _refill(body, "".join(chr(65 + value // 26**i % 26) for i in range(len(letters))), str.isalpha)
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    return _refill(text, plain[:2] + f"{check:02d}" + body, str.isalnum)


def _date(text: str, key: bytes, back: bool) -> str | None:
    match = DATE.fullmatch(text)
    parts = [match[1], match[3], match[4]] if match[1] else [match[5], match[7], match[8]]
    # Day before month unless only the other order is a date; the order read is kept in the pseudonym.
    orders = [(0, 1, 2)] if match[1] else [(2, 1, 0), (2, 0, 1)]
    days = (LAST_DAY - FIRST_DAY).days + 1
    widths = [len(part) for part in parts]

    def write(day: datetime.date, order: tuple[int, int, int]) -> str | None:
        values = dict(zip(order, (day.year, day.month, day.day), strict=True))
        made = [str(values[i]).zfill(widths[i]) for i in range(3)]
        return None if [len(part) for part in made] != widths else made

    def read(values: list[str]) -> tuple[datetime.date, tuple[int, int, int]] | None:
        for order in orders:
            try:
                day = datetime.date(*(int(values[i]) for i in order))
            except ValueError:
                continue
            if FIRST_DAY <= day <= LAST_DAY:
                return day, order
        return None

    found = read(parts)
    if found is None:
        return None
    day, order = found

    def fits(value: int) -> bool:
        other = FIRST_DAY + datetime.timedelta(value)
        made = write(other, order)
        # What is written must be read as the same date again, or the key would not give it back.
        return made is not None and read(made) == (other, order)

    tag = b"date%d%d" % (order[0], order[1]) + bytes(widths)
    value = permute_within((day - FIRST_DAY).days, days, fits, key, tag, back)
    made = write(FIRST_DAY + datetime.timedelta(value), order)
    signs = match[2] or match[6]
    return signs.join(made)


def _ip(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(part) > 255 or (len(part) > 1 and part[0] == "0") for part in parts):
        return None
    # Every part stays within the values of its length: 0-9, 10-99, 100-255.
    value, size, bounds = 0, 1, [((0, 10), (10, 90), (100, 156))[len(part) - 1] for part in parts]
    for part, (least, width) in zip(parts, bounds, strict=True):
        value += (int(part) - least) * size
        size *= width
    value = permute_within(value, size, lambda _: True, key, b"ip" + bytes(map(len, parts)), back)
    made = []
    for least, width in bounds:
        value, part = divmod(value, width)
        made.append(str(least + part))
    return ".".join(made)


def is_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(text: str, key: bytes, back: bool) -> str | None:
    digits = text.replace("-", "")
    return _refill(text, _digits(digits, key, b"ssn", back, is_ssn)) if is_ssn(digits) else None


def _phone(text: str, key: bytes, back: bool) -> str | None:
    code = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    start = code.end() if code else 1 if text[0] == "+" else 0
    digits = re.sub(r"\D", "", text[start:])
    if not 7 <= len(digits) <= 15:
        return None
    return text[:start] + _refill(text[start:], _digits(digits, key, b"phone", back))


def _email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    # Letters and digits keep their kind and place; the same address in capitals has a pseudonym of its own.
    sizes = [10 if sign.isdigit() else 26 for sign in local if sign.isalnum()]
    value, size = 0, 1
    signs = [sign for sign in local if sign.isalnum()]
    for sign, width in zip(signs, sizes, strict=True):
        value += (int(sign) if width == 10 else ord(sign.lower()) - 97) * size
        size *= width
    form = "".join("0" if s.isdigit() else "A" if s.isupper() else "a" for s in signs)
    value = permute_within(value, size, lambda _: True, key, b"email" + form.encode() + domain.lower().encode(), back)
    made = []
    for sign, width in zip(signs, sizes, strict=True):
        value, part = divmod(value, width)
        made.append(str(part) if width == 10 else chr((65 if sign.isupper() else 97) + part))
    return f"{_refill(local, ''.join(made), str.isalnum)}@{domain}"


FORMATS = dict(
    zip(KINDS, ((EMAIL, _email), (IBAN, _iban), (CARD, _card), (DATE, _date), (IP, _ip), (SSN, _ssn), (PHONE, _phone)), strict=True)
)


def _places(kind: str, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The match itself, then what a card or IBAN may be inside it: whole groups, early starts and long ones first.

    A security code, an expiry date or a short word behind a value is matched along with it.
    """
    yield start, end
    if kind not in ("card", "iban"):
        return
    groups = [match.span() for match in GROUP.finditer(text, start, end)]
    # An IBAN inside is met again from its own start, as only its first signs can be one.
    for first, _ in groups if kind == "card" else groups[:1]:
        for _, last in reversed(groups):
            if last > first and (first, last) != (start, end):
                yield first, last


def _find(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """What ``find`` gives, and the matches of cards and IBANs that are no value as a whole."""
    found: list[tuple[int, int, str]] = []
    failed: list[tuple[int, int]] = []
    taken = bytearray(len(text))
    digits = any(sign in text for sign in "0123456789")
    for kind, (pattern, change) in FORMATS.items():
        if (kind == "email" and "@" not in text) or (kind != "email" and not digits):
            continue
        match = pattern.search(text)
        while match:
            at = match.start() + 1
            for start, end in _places(kind, text, *match.span()):
                if not any(taken[start:end]) and change(text[start:end], KEY, False) is not None:
                    taken[start:end] = b"\1" * (end - start)
                    found.append((start, end, kind))
                    at = end
                    break
            if kind in ("card", "iban") and (not found or found[-1] != (*match.span(), kind)):
                failed.append(match.span())
            match = pattern.search(text, at)
    return sorted(found), failed


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the validated values of a text, in order, not overlapping."""
    return _find(text)[0]


def pseudonyms(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every value replaced, and the values' places in the given text."""
    found, failed = _find(text)
    covered = bytearray(len(text))
    for start, end in failed:
        covered[start:end] = b"\1" * (end - start)
    signs = list(text)
    # Going back, values are replaced in the opposite order, so each one sees the same neighbours.
    for start, end, kind in reversed(found) if back else found:
        change = FORMATS[kind][1]
        made = change("".join(signs[start:end]), key, back)
        if any(covered[start:end]):
            # With other digits a longer match could become valid; the permutation is walked on until
            # the same values are found again, or the key would not give them back.
            before, after = "".join(signs[max(0, start - NEAR) : start]), "".join(signs[end : end + NEAR])
            wanted = find(before + "".join(signs[start:end]) + after)
            while find(before + made + after) != wanted:
                made = change(made, key, back)
        signs[start:end] = made
    return "".join(signs), found


def pseudonymise(docs: DataFrame, keep: list[str], key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """``keep``, the text with pseudonyms, the number of values of each kind and their spans in the input.

    Spans are ``kind:start:end`` in code points, the end excluded, joined by commas. A null text stays
    null with counts of 0, an empty one stays empty. Repeated rows give the same pseudonyms. Columns not
    named in ``keep`` are not read; ``text`` of the result is the new text. An empty table gives an
    empty result.
    """

    def run(texts: list[str | None]) -> dict[str, list]:
        out: dict[str, list] = {name.split()[0]: [] for name in MADE.split(", ")} | {"text": []}
        known: dict[str, tuple[str, list]] = {}
        for text in texts:
            made, found = (text, []) if not text else known.get(text) or known.setdefault(text, pseudonyms(text, key))
            out["text"].append(made)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(1 for span in found if span[2] == kind))
            out["spans"].append(",".join(f"{kind}:{start}:{end}" for start, end, kind in found))
        return out

    return add_columns(docs, text_col, run, f"text string, {MADE}", [name for name in keep if name != "text"])
