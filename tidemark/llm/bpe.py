"""Byte-level BPE encoding and decoding (operator 1).

A long text is cut into chunks that overlap. Chunks are pre-tokenised in parallel, each from its own
start. Where the pre-token boundaries of two neighbours meet in their overlap the chunks are stitched:
from a shared boundary on, the pattern matches the same in both. The pieces between stitches start and
end at true boundaries, so they are encoded on their own and their ids are put together in order.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import add_columns, expand

# Code points per chunk, and how far a chunk reads into the next one. A text of one chunk is one piece.
CHUNK_CHARS = 65_536
OVERLAP_CHARS = 2_048


class Vocabulary:
    """Ranks and pre-token pattern; small and of fixed size, so it is sent to the tasks."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.rank_file, self.pattern = rank_file, pattern

    @classmethod
    def load(cls, path: str | None = None, pattern: str | None = None) -> Vocabulary:
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
            return cls(file.read(), pattern or public_tokenizers.PATTERN)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.rank_file.splitlines())}

    def encoder(self) -> Callable[[str], np.ndarray]:
        coder = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return lambda text: np.array(coder.encode_ordinary(text), dtype="<u4")

    def decoder(self) -> Callable[[np.ndarray], bytes]:
        ranks = self.ranks()
        size = max(ranks.values(), default=-1) + 1
        table = np.empty(size, object)
        for token, rank in ranks.items():
            table[rank] = token
        return lambda ids: b"".join(table[ids].tolist())


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of ``text``, matched from its first character on, and its end."""
    # The encoder's white space is the Unicode property; regex's own \\s has four control characters more.
    pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    return [match.start() for match in regex.finditer(pattern, text)] + [len(text)]


def chunk_rows(docs: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(text_key, chunk, part): chunks of the long texts, each with the start of the next one."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk_chars).cast("int"))
    long = docs.where(F.length("text") > chunk_chars).select("text_key", "text")
    cut = F.substring("text", F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars + overlap_chars))
    return long.select("text_key", "text", F.explode(starts).alias("chunk")).select(
        "text_key", "chunk", cut.alias("part")
    )


def stitch_points(chunks: DataFrame, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(text_key, chunk, begin, finish): the piece of every chunk, as offsets into its ``part``.

    ``begin`` of a later chunk is the first boundary it shares with the chunk before, in the overlap.
    Where there is none, all pieces of that text are null and it is encoded whole: a chunk is only
    known to be right after it met a chunk that is.
    """

    def ends(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"text_key": columns["text_key"], "chunk": columns["chunk"], "head": [], "tail": []}
        for part in columns["part"]:
            found = np.array(boundaries(part, pattern))
            out["head"].append(found[found < overlap_chars].tolist())
            # The end of a part is a boundary only because the part was cut there.
            tail = found[(found >= chunk_chars) & (found < len(part))].tolist()
            # No piece may end in white space: the pattern looks at what follows a run of it.
            out["tail"].append([at - chunk_chars for at in tail if not part[at - 1].isspace()])
        return out

    rows = expand(chunks, ends, "text_key binary, chunk int, head array<int>, tail array<int>")
    order = Window.partitionBy("text_key").orderBy("chunk")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    rows = rows.select("text_key", "chunk", F.when(F.col("chunk") == 0, 0).otherwise(met).alias("begin"))
    whole = Window.partitionBy("text_key")
    return rows.select(
        "text_key",
        "chunk",
        "begin",
        (F.lead("begin").over(order) + chunk_chars).alias("finish"),
        F.min(F.col("begin").isNotNull()).over(whole).alias("stitched"),
    )


def encode(
    docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the token ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (empty bytes). Rows that repeat in every column share one
    encoding and stay as many as they are; each row keeps its own columns, whatever their names.
    The name ``ids`` is replaced if it is taken. An empty table gives an empty result.
    """
    pattern = vocabulary.pattern
    columns = [name for name in docs.columns if name != "ids"]
    inner = {name: f"col_{i}" for i, name in enumerate(columns)}
    rows = docs.select(*[F.col(f"`{name}`").alias(alias) for name, alias in inner.items()])
    text = inner["text"]
    short = F.coalesce(F.length(text), F.lit(0)) <= chunk_chars

    def encode_texts(texts: list[str | None]) -> dict[str, list]:
        coder = made[0] if made else made.append(vocabulary.encoder()) or made[0]
        return {"ids": [coder(value).tobytes() if value else b"" for value in texts]}

    made: list = []
    few = rows.where(short)
    few = add_columns(few, text, encode_texts, "ids binary", list(inner.values()))
    # The key holds the whole row, so copies of one long text are spread like other rows.
    many = rows.where(~short).withColumn("text_key", F.unhex(F.sha2(F.to_json(F.struct(*inner.values())), 256)))
    distinct = many.groupBy("text_key").agg(F.first(text).alias("text"))
    chunks = chunk_rows(distinct, chunk_chars, overlap_chars).repartition("text_key", "chunk")
    points = stitch_points(chunks, pattern, chunk_chars, overlap_chars)
    pieces = chunks.join(points.where("stitched"), ["text_key", "chunk"]).select(
        "text_key",
        "chunk",
        F.expr("substring(part, begin + 1, coalesce(finish, length(part)) - begin)").alias("piece"),
    )
    whole = points.where("chunk = 0 and not stitched").select("text_key", "chunk")
    pieces = pieces.unionByName(distinct.join(whole, "text_key").select("text_key", "chunk", F.col("text").alias("piece")))
    encoded = add_columns(pieces, "piece", encode_texts, "ids binary", ["text_key", "chunk"])
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    joined = F.aggregate(parts["ids"], F.lit(b""), lambda done, ids: F.concat(done, ids))
    put_together = encoded.groupBy("text_key").agg(joined.alias("ids"))
    many = many.join(put_together, "text_key").drop("text_key")
    both = few.unionByName(many)
    return both.select(*[F.col(alias).alias(name) for name, alias in inner.items()], "ids")


def decode(rows: DataFrame, vocabulary: Vocabulary, keep: list[str]) -> DataFrame:
    """``keep`` and ``decoded``, the concatenated bytes of ``ids``; null ids decode to no bytes."""
    made: list = []

    def run(values: list[bytes | None]) -> dict[str, list]:
        table = made[0] if made else made.append(vocabulary.decoder()) or made[0]
        return {"decoded": [table(np.frombuffer(value or b"", "<u4")) for value in values]}

    return add_columns(rows, "ids", run, "decoded binary", keep)


def encode_digests(
    docs: DataFrame, vocabulary: Vocabulary, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to."""
    encoded = encode(docs.select("doc_id", "text"), vocabulary, chunk_chars, overlap_chars).select("doc_id", "ids")
    made: list = []

    def digests(values: list[bytes]) -> dict[str, list]:
        table = made[0] if made else made.append(vocabulary.decoder()) or made[0]
        return {
            "n_tokens": [len(value) // 4 for value in values],
            "ids_sha256": [hashlib.sha256(value).hexdigest() for value in values],
            "decoded_sha256": [hashlib.sha256(table(np.frombuffer(value, "<u4"))).hexdigest() for value in values],
        }

    return add_columns(encoded, "ids", digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])
