"""Secret scan with structural confirmation (operator 10).

Patterns find assignments, access keys and hex runs. Beyond them, base64 and hex candidates are
decoded and only reported if their structure holds: nested lengths of a DER key, the fields of an
OpenSSH key, or the header of a signed token. Keys may start at any bit that can be the first of a byte,
so bytes or signs before a key do not hide it. Lengths are walked without decoding what they skip, and
what a walk finds is remembered, so time grows in proportion to the text, however often marks repeat.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from tidemark.llm.common import add_columns, computed

MADE = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_confirmed bigint"
# The base patterns and the least length of what they must match, in the order of the kinds.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
# The kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "ssh", "der")

PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\\-]*")
# A JSON object, perhaps after white space, begins with one of these signs in base64.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{7,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
# Base64 in either alphabet, over line ends, also those written as a backslash and a letter.
LINE_END = r"(?:[ \t]*\r?\n[ \t]*|(?:\\+[rn])+)"
BASE64_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
BASE64_RUN = re.compile(rf"[A-Za-z0-9+/_-]+(?:{LINE_END}[A-Za-z0-9+/_-]+)*={{0,2}}")
HEX_LINE = re.compile(r"[0-9A-Fa-f]+")
HEX_RUN = re.compile(rf"[0-9A-Fa-f]+(?:{LINE_END}[0-9A-Fa-f]+)*")
LEAST_BYTES = 30
SSH_MAGIC = b"openssh-key-v1\x00"
SSH_FIELD = re.compile(rb"\0\0\0[\x06-\x2f](?:ssh|ecdsa|sk)-")
SSH_NAME = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,40}")
PEM_BEGIN = b"-----BEGIN "


def _at_offsets(data: bytes) -> list[tuple[str, str]]:
    """How bytes read in base64 at each of three offsets, and the signs before that are not theirs alone."""
    marks = []
    for offset, before in enumerate((0, 2, 3)):
        signs = base64.b64encode(b"\0" * offset + data).decode()
        marks.append((signs[before : (offset + len(data)) * 8 // 6], signs[:before]))
    return marks


@dataclass
class Form:
    """An encoding of bytes: bits of a sign, its lines and runs, and where keys can start.

    For every group of ``starts`` there is a kind of start: PEM marks with the signs they share with what
    is before, other kinds with the first bit of the key, counted from the sign that was found.
    """

    bits: int
    line: re.Pattern
    run: re.Pattern
    # Runs of the least key's signs on one line, or of any over several.
    long: re.Pattern
    kinds: list[tuple[str, str | int]]
    starts: re.Pattern


# First signs of a DER sequence of 30 bytes or more, and of an SSH field that begins with s or e, at each
# offset in a group of base64, with the first bit of the key in the first sign; then those in hex.
BASE64_FIRSTS = [
    ("der", 0, ["M", "[A-P]"]), ("der", 2, ["[DTjz]", "[A-C]"]), ("der", 4, ["[AEIMQUYcgkosw048]", "w", "[H-Za-g]"]),
    ("ssh", 0, [*"AAAA", "[A-L]", "[GHWXmn23]", "[M-PU-X]"]), ("ssh", 2, ["[AQgw]", *"AAA", "[A-C]", "[BFJNRVZdhlptx159]", "[lz]"]),
    ("ssh", 4, ["[AEIMQUYcgkosw048]", *"AAAA", "[G-Za-v]", "[Zc]"]),
]
HEX_FIRSTS = [("der", 0, [*"30", "[1-8]"]), ("ssh", 0, [*"000000", "[0-2]", "[0-9A-Fa-f]", "[67]", "[35]"])]


def _form(bits: int, line: re.Pattern, run: re.Pattern, firsts: list, marks: list[tuple[str, str | int, list[str]]]) -> Form:
    """A line may end between any two signs. After first signs there must be enough for the least key."""
    sign, left = line.pattern.rstrip("+"), LEAST_BYTES * 8 // bits - 2
    enough = f"(?={sign}(?:(?>{LINE_END})?+{sign}){{{left}}})"
    found = []
    for signs, after in [*((signs, "") for _, _, signs in marks), *((signs, enough) for _, _, signs in firsts)]:
        rest = "".join(f"(?:{LINE_END})?{other}" for other in signs[1:])
        found.append(f"({signs[0]}(?={rest}){after})")
    more_lines = f"(?>{LINE_END}{sign}++)"
    long = re.compile(f"(?<!{sign})(?:{sign}{{{left + 2},}}+{more_lines}*+|{sign}++{more_lines}++)")
    return Form(bits, line, run, long, [(kind, more) for kind, more, _ in [*marks, *firsts]], re.compile("|".join(found)))


def _base64_form() -> Form:
    marks: list = [("pem", before, list(mark)) for mark, before in _at_offsets(PEM_BEGIN)]
    marks += [("ssh", 8 * i - 6 * len(before), list(mark)) for i, (mark, before) in enumerate(_at_offsets(SSH_MAGIC))]
    return _form(6, BASE64_LINE, BASE64_RUN, BASE64_FIRSTS, marks)


def _hex_form() -> Form:
    marks: list = [(kind, more, [f"[{sign}{sign.upper()}]" for sign in mark.hex()]) for kind, more, mark in (("pem", "", PEM_BEGIN), ("ssh", 0, SSH_MAGIC))]
    return _form(4, HEX_LINE, HEX_RUN, HEX_FIRSTS, marks)


BASE64, HEX_TEXT = _base64_form(), _hex_form()
DER_SEQUENCE, DER_INTEGER, DER_BYTES, DER_OID, DER_BITS = 0x30, 0x02, 0x04, 0x06, 0x03


def decode_base64(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, padded or not; None if it cannot be one."""
    run = "".join(run.split()).rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def decode_start(signs: str) -> bytes:
    """The bytes of base64 signs without padding; a last sign that is no byte is left out."""
    signs = signs[: len(signs) - (len(signs) % 4 == 1)].translate(str.maketrans("-_", "+/"))
    return base64.b64decode(signs + "=" * (-len(signs) % 4))


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value at ``at``; None unless its length fits before ``end``."""
    if at + 2 > end:
        return None
    tag, first = data[at], data[at + 1]
    start = at + 2
    if first >= 0x80:
        width = first & 0x7F
        if not 1 <= width <= 4 or start + width > end:
            return None
        first = int.from_bytes(data[start : start + width], "big")
        start += width
    return (tag, start, start + first) if start + first <= end else None


def der_children(read: Callable[[int, int], bytes], start: int, end: int, most: int) -> list[tuple[int, int, int]]:
    """Tag, start and end of the values that fill ``start`` to ``end`` exactly; none if they do not or are more than ``most``."""
    items = []
    while start < end:
        item = der_item(read(start, 6), 0, end - start) if len(items) < most else None
        if item is None:
            return []
        items.append((item[0], start + item[1], start + item[2]))
        start = items[-1][2]
    return items


def der_key_size(read: Callable[[int, int], bytes], limit: int) -> int | None:
    """The size of the key encoding at the start of what ``read`` gives, if its nested lengths add up within ``limit``.

    PKCS#1 (version and eight integers, perhaps more primes), SEC1 (version 1, a byte string), PKCS#8 (version,
    algorithm, byte string; both with up to two optional values), encrypted PKCS#8 (algorithm, byte string) or a
    public key (algorithm, bit string). ``read`` takes a place and a number of bytes; only heads are read.
    """
    outer = der_item(read(0, 6), 0, limit)
    if outer is None or outer[0] != DER_SEQUENCE:
        return None
    items = der_children(read, outer[1], outer[2], 10)
    tags = [tag for tag, _, _ in items]

    def algorithm(item: tuple[int, int, int]) -> bool:
        inner = der_children(read, item[1], item[2], 2)
        return bool(inner) and inner[0][0] == DER_OID

    if tags[:9] == [DER_INTEGER] * 9:
        fits = True
    elif tags[:3] == [DER_INTEGER, DER_SEQUENCE, DER_BYTES]:
        fits = algorithm(items[1])
    elif tags[:2] == [DER_INTEGER, DER_BYTES]:
        fits = read(items[0][1], items[0][2] - items[0][1]) == b"\x01" and items[1][2] - items[1][1] >= 16
    else:
        fits = tags in ([DER_SEQUENCE, DER_BYTES], [DER_SEQUENCE, DER_BITS]) and algorithm(items[0])
    return outer[2] if fits else None


def is_der_key(data: bytes) -> bool:
    """Whether the bytes are one key encoding (``der_key_size``)."""
    return der_key_size(lambda at, size: data[at : at + size], len(data)) == len(data)


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or the wire form of a public one: named fields with their lengths."""
    if data.startswith(SSH_MAGIC):
        at, names = len(SSH_MAGIC), 3
    else:
        at, names = 0, 1
    for _ in range(names):
        size = int.from_bytes(data[at : at + 4], "big")
        if len(data) < at + 4 + size:
            return False
        field, at = data[at + 4 : at + 4 + size], at + 4 + size
    if names == 3:
        return int.from_bytes(data[at : at + 4], "big") >= 1 and len(data) >= at + 8
    if not SSH_NAME.fullmatch(field):
        return False
    while at < len(data):
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def is_token(header: str, body: str) -> bool:
    """Whether the first part is the JSON header of a signed token and the second is base64 too."""
    decoded = decode_base64(header)
    if decoded is None or decode_base64(body) is None:
        return False
    try:
        fields = json.loads(decoded)
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str)


def pem_holds(label: str, body: str) -> bool:
    """Whether the block between PEM marks decodes to a key; legacy encrypted blocks carry header lines."""
    body = re.sub(r"(?<!\\)\\+/", "/", re.sub(r"(?<!\\)\\+[nrt]", "\n", body))
    lines = [line.strip() for line in body.strip().splitlines()]
    encrypted = any(line.startswith("Proc-Type:") for line in lines)
    data = decode_base64("".join(line for line in lines if ":" not in line))
    if not data:
        return False
    return encrypted or is_der_key(data) or is_ssh_key(data) or label.startswith("PGP")


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of the key blocks: an end mark and the nearest mark before it, if that begins the same label."""
    found, begin = [], None
    for mark in PEM_MARK.finditer(text):
        if mark[1] == "BEGIN":
            begin = mark
            continue
        if begin is not None and begin[2] == mark[2] and PEM_BODY.fullmatch(text, begin.end(), mark.start()):
            if pem_holds(mark[2], text[begin.end() : mark.start()]):
                found.append((begin.start(), mark.end()))
        begin = None
    return found


class Run:
    """A run of encoded signs without its line ends, and where each of its signs is in the text.

    Places in the decoded bytes are told by their first bit in the run, so a key can start at any of them.
    """

    def __init__(self, form: Form, text: str, at: int) -> None:
        self.form, self.bits = form, form.bits
        while at and form.line.match(text, at - 1):
            at -= 1
        self.start, self.end = form.run.match(text, at).span()
        lines = []
        for part in re.split(f"({LINE_END})", text[self.start : self.end]):
            if form.line.match(part):
                lines.append((at, part.rstrip("=")))
            at += len(part)
        self.places = [place for place, _ in lines]
        # For every line the number of signs up to its end.
        self.ends = list(itertools.accumulate(len(line) for _, line in lines))
        self.signs = "".join(line for _, line in lines)
        self.pem_read: set[int] = set()
        # The last line end that a chain of fields meets after a bit, and whether it meets the next sign of
        # either alphabet that the other one lacks.
        self.line_ends, self.last_ends = set(self.ends), {}
        alphabets = ("[-_]", "[+/]") if form is BASE64 else ()
        self.others = [[match.start() for match in re.finditer(signs, self.signs)] for signs in alphabets]
        self.meets: list[tuple[int, dict[int, bool]]] = [(-1, {}) for _ in self.others]

    def index(self, place: int) -> int:
        line = bisect.bisect_right(self.places, place) - 1
        return (self.ends[line - 1] if line else 0) + place - self.places[line]

    def place(self, index: int) -> int:
        line = bisect.bisect_right(self.ends, index)
        return self.places[line] + index - (self.ends[line - 1] if line else 0)

    def end_place(self, index: int) -> int:
        """Where the signs up to ``index`` end in the text; padding belongs to the last of them."""
        return self.end if index == len(self.signs) else self.place(index - 1) + 1

    def end_sign(self, bit: int) -> int:
        return -(-bit // self.bits)

    def read(self, bit: int, size: int) -> bytes:
        """At most ``size`` bytes from a bit on."""
        first, rest = divmod(bit, self.bits)
        if self.bits == 4:
            signs = self.signs[first : first + 2 * size]
            return bytes.fromhex(signs[: len(signs) // 2 * 2])
        ahead = rest // 2
        return decode_start("A" * ahead + self.signs[first : first + (size + ahead) * 4 // 3 + 2 - ahead])[ahead : ahead + size]

    def next_field(self, bit: int) -> int | None:
        """The first bit after a field with its length; None if the run ends before."""
        head = self.read(bit, 4)
        after = bit + 32 + 8 * int.from_bytes(head, "big")
        return after if len(head) == 4 and self.end_sign(after) <= len(self.signs) else None

    def last_line_end(self, bit: int | None) -> int | None:
        """Of the line ends that the fields from a bit on meet, the last."""
        chain = []
        while bit is not None and bit not in self.last_ends:
            chain.append(bit)
            bit = self.next_field(bit)
        for before in reversed(chain):
            found = None if bit is None else self.last_ends[bit]
            if found is None and bit is not None and self.end_sign(bit) in self.line_ends:
                found = self.end_sign(bit)
            self.last_ends[before] = found
            bit = before
        return self.last_ends[bit]

    def meets_other(self, which: int, at: int, bit: int | None) -> int | None:
        """The next sign of one alphabet after a start, if the fields from a bit on end just before it."""
        places = self.others[which]
        later = bisect.bisect_left(places, at)
        if later == len(places):
            return None
        if self.meets[which][0] != places[later]:
            self.meets[which] = (places[later], {})
        target, known = self.meets[which]
        chain, met = [], False
        while bit is not None and bit not in known:
            chain.append(bit)
            bit = self.next_field(bit)
            if bit is not None and self.end_sign(bit) >= target:
                met = self.end_sign(bit) == target
                break
        else:
            met = bit is not None and known[bit]
        known.update(dict.fromkeys(chain, met))
        return target if met else None

    def der_end(self, bit: int) -> int | None:
        """The end of a DER key that starts at a bit."""
        size = der_key_size(lambda at, size: self.read(bit + 8 * at, size), (len(self.signs) * self.bits - bit) // 8)
        return None if size is None or size < LEAST_BYTES else self.end_sign(bit + 8 * size)

    def ssh_end(self, bit: int) -> int | None:
        """The end of an SSH key that starts at a bit: of the places where a key can end, the last.

        These are the ends of lines, and, as a key has one alphabet, signs of the other one.
        """
        head, left = self.read(bit, 60), (len(self.signs) * self.bits - bit) // 8
        if head.startswith(SSH_MAGIC):
            at: int | None = bit + 8 * len(SSH_MAGIC)
            for _ in range(3):
                at = None if at is None else self.next_field(at)
            if at is None or left < LEAST_BYTES or (at - bit) // 8 + 8 > left or not any(self.read(at, 4)):
                return None
            return len(self.signs)
        if not SSH_FIELD.match(head) or not SSH_NAME.fullmatch(head[4 : 4 + head[3]]) or left < 4 + head[3]:
            return None
        after = bit + 8 * (4 + head[3])
        ends = [self.last_line_end(after), *[self.meets_other(i, bit // self.bits, after) for i in range(len(self.others))]]
        return max((end for end in ends if end is not None and end * self.bits - bit >= 8 * LEAST_BYTES), default=None)

    def pem_spans(self, at: int, before: str) -> list[tuple[int, int]]:
        """First and last sign of the PEM blocks from an encoded mark on, in all of the run that is read with it.

        ``before`` are the signs that the mark shares with what is before it.
        """
        offset = at - len(before)
        group = 24 // self.bits if self.bits == 6 else 2
        if offset % group in self.pem_read:
            return []
        self.pem_read.add(offset % group)
        signs = before + self.signs[at:]
        data = (decode_start(signs) if self.bits == 6 else bytes.fromhex(signs[: len(signs) // 2 * 2])).decode("latin-1")
        found = []
        for start, end in pem_blocks(data):
            # What follows the block in the last signs is at most a line end.
            last = len(self.signs) if not data[end:].strip() else offset + self.end_sign(end * 8)
            found.append((max(at, offset + start * 8 // self.bits), last))
        return found

    def keys_at(self, at: int, kind: str, more: str | int) -> list[tuple[int, int, int]]:
        """(first sign, kind, last sign) of the key that starts at a sign, or of the PEM blocks from a mark there on."""
        if kind == "pem":
            return [(first, 3, last) for first, last in self.pem_spans(at, more)]
        bit = self.bits * at + more
        # A key whose first sign is before the run is not whole.
        end = None if bit < 0 else self.der_end(bit) if kind == "der" else self.ssh_end(bit)
        return [] if end is None else [(bit // self.bits, KINDS.index(kind), end)]


def encoded_spans(text: str, form: Form) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the encoded keys, wherever in a run they start; one inside another is left out."""
    found: list[tuple[int, int, int]] = []
    ahead: list[tuple[int, int]] = []
    covered, run = 0, None
    least = LEAST_BYTES * 8 // form.bits
    runs = (whole.span() for whole in form.long.finditer(text) if whole.end() - whole.start() >= least)
    for match in itertools.chain.from_iterable(form.starts.finditer(text, *span) for span in runs):
        while ahead and ahead[0][0] <= match.start():
            covered = max(covered, heappop(ahead)[1])
        if match.start() < covered:
            continue
        if run is None or match.start() >= run.end:
            run = Run(form, text, match.start())
        for first, kind, last in run.keys_at(run.index(match.start()), *form.kinds[match.lastindex - 1]):
            found.append((run.place(first), kind, run.end_place(last)))
            heappush(ahead, (found[-1][0], found[-1][2]))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and not overlapping within a kind."""
    found = []
    for match in ASSIGN.finditer(text):
        if match.end(2) - match.start(2) >= ASSIGN_LENGTH:
            found.append((match.start(), 0, match.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(match.start(), 2, match.end()) for match in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of signed tokens. What is before a token may look like the first part of one."""
    found = []
    match = TOKEN.search(text)
    while match:
        holds = is_token(match[1], match[2])
        if holds:
            found.append((match.start(), 4, match.end()))
        match = TOKEN.search(text, match.end() if holds else match.end(1))
    return found


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure was confirmed."""
    found = []
    if "PRIVATE KEY-----" in text:
        found += [(start, 3, end) for start, end in pem_blocks(text)]
    starts, ends = [start for start, _, _ in found], [end for _, _, end in found]
    if "." in text:
        found += token_spans(text)
    for start, kind, end in itertools.chain(encoded_spans(text, BASE64), encoded_spans(text, HEX_TEXT)):
        block = bisect.bisect_right(starts, start) - 1
        if block < 0 or ends[block] <= start:
            found.append((start, kind, end))
    return sorted(set(found))


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {name.split()[0]: [] for name in MADE.split(", ")}
    for text in texts:
        text = text or ""
        base = base_spans(text)
        more = confirmed_spans(text)
        for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(1 for span in base if span[1] == kind))
        out["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
        out["spans"].append(_listed(sorted(base + more)))
        out["n_confirmed"].append(len(more))
    return out


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and the columns of ``MADE`` for every document.

    Spans are counted in code points, the end excluded. Null and empty texts have none: counts of 0,
    empty ``spans`` and the digest of the empty list. Repeated rows are scanned one by one; columns
    not named in ``keep`` are not read, so their names cannot clash. An empty table gives an empty result.
    """
    return add_columns(docs, text_col, scan, MADE, keep)


def masked(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans become one. Null stays null."""
    if not text:
        return text
    parts, at = [], 0
    spans: list[list[int]] = []
    for start, _, end in sorted(base_spans(text) + confirmed_spans(text)):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    for start, end in spans:
        parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:]


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents and columns, with secrets replaced in the text; no row is dropped."""
    return docs.withColumn(text_col, computed(text_col, lambda texts: [masked(text) for text in texts], "string"))
