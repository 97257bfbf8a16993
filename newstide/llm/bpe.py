"""Byte-level BPE with the tokenizers library, for ranks in the tiktoken format.

The library works on characters, so each of the 256 bytes stands for one printable character, and
the vocabulary and its merges are spelt in these. A merge is listed for every pair of tokens whose
bytes together are a token, in the order of the ranks, which is how a rank file is applied.

A text is cut where a single space follows and no blank comes next; there the split pattern always
begins a new match. The parts recur, so their ids are kept, and only parts not seen by this task go
through the library. Long parts, as of text without blanks, are not kept. A text with runs of blanks is cut by the pattern itself. Decoding looks the
bytes of every id up in the reversed byte table and joins them before any character is formed, so a
character that is spread over several ids comes out whole.
"""

import base64
import functools
import hashlib
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from newstide.llm.common import PartCache, row_of, row_udf

# Bytes that a Python worker keeps of recurring parts and their ids.
CACHED_BYTES = 96 << 20
_BLANK_AFTER_SPACE = re.compile(r" (?=\s|\Z)")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}


def split_parts(text: str, pattern) -> list[str]:
    """Parts that are tokenized independently of each other."""
    if _BLANK_AFTER_SPACE.search(text):
        return pattern.findall(text)
    first, *rest = text.split(" ")
    parts = [" " + part for part in rest]
    return [first, *parts] if first else parts


def _packed_ids(tokenizer, part: str) -> bytes:
    """Ids of a part as little-endian 32-bit words."""
    return np.array(tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        spelt = byte_characters()
        back = {c: b for b, c in spelt.items()}

        def spell(token: bytes) -> str:
            return "".join(map(spelt.__getitem__, token))

        merges = [(spell(token[:at]), spell(token[at:]))
                  for token, _ in sorted(ranks.items(), key=lambda item: item[1])
                  for at in range(1, len(token)) if token[:at] in ranks and token[at:] in ranks]
        tokenizer = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()},
                                         merges=merges, ignore_merges=True))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pattern = regex.compile(pattern)
        self.ids = PartCache(functools.partial(_packed_ids, tokenizer), CACHED_BYTES)
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, rank in tokenizer.get_vocab().items():
            self.bytes_of[rank] = bytes(map(back.__getitem__, token))
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)

    def encode(self, text: str) -> np.ndarray:
        parts = split_parts(text, self.pattern)
        return np.frombuffer(b"".join(map(self.ids.__getitem__, parts)), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every token in characters; a split character belongs to all its tokens."""
        data = np.frombuffer(text.encode(), np.uint8)
        # number of the character that each byte is part of
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.length_of[ids])
        starts = ends - self.length_of[ids]
        return character[starts], character[ends - 1] + 1


_CODECS: dict[bytes, Codec] = {}


def codec(file: bytes, pattern: str) -> Codec:
    """The codec of a rank file, built once per Python process."""
    key = hashlib.sha256(file + pattern.encode()).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(parse_ranks(file), pattern)
    return _CODECS[key]


def _shared_file(spark: SparkSession, path: str):
    """A vocabulary file, sent to every executor once. These files are a few MB at most."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _with_fields(df: DataFrame, made, fields: dict[str, str]) -> DataFrame:
    """All columns of ``df`` and the named fields of the struct ``made``, which is computed once."""
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in fields]
    return (df.select(row_of(df).alias("row"), made.alias("made"))
            .select(*kept, *[F.col("made")[field].alias(c) for c, field in fields.items()]))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text",
           ids_col: str = "ids", offsets: bool = False) -> DataFrame:
    """Add the ids of every text, with ``offsets`` also ``token_starts`` and ``token_ends``.

    All columns stay; one with the name of a new column is replaced. A null or empty text has no
    ids, an empty table gives no rows, repeated rows are encoded each. A very long text is one
    array of its ids. Special tokens are ordinary text.
    """
    file = _shared_file(docs.sparkSession, path)

    def make():
        tool = codec(file.value, pattern)

        def one(text):
            ids = tool.encode(text or "")
            if not offsets:
                return (ids.tolist(),)
            starts, ends = tool.offsets(text or "", ids)
            return ids.tolist(), starts.tolist(), ends.tolist()
        return one

    added = {ids_col: "ids", **({"token_starts": "starts", "token_ends": "ends"} if offsets else {})}
    schema = ", ".join(f"{name} array<int>" for name in added.values())
    return _with_fields(docs, row_udf(schema, make)(docs[text_col]), added)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids",
           text_col: str = "decoded") -> DataFrame:
    """Add the text of every array of ids; broken characters become U+FFFD, null ids give null."""
    file = _shared_file(tokens.sparkSession, path)

    def make():
        tool = codec(file.value, pattern)
        return lambda ids: (None if ids is None else tool.decode(ids).decode(errors="replace"),)

    return _with_fields(tokens, row_udf("text string", make)(tokens[ids_col]), {text_col: "text"})


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode and decode every text, one row per row of ``docs``.

    doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of
    the decoded bytes), n_split (tokens that end inside a character). Null texts count as empty,
    repeated rows are returned each, an empty table gives no rows; texts of any length are encoded
    whole. Other columns of ``docs`` never enter, so their names cannot clash.
    """
    file = _shared_file(docs.sparkSession, path)

    def make():
        tool = codec(file.value, pattern)

        def one(text):
            ids = tool.encode(text or "")
            decoded = tool.decode(ids.tolist())
            data = np.frombuffer(decoded, np.uint8)
            ends = np.cumsum(tool.length_of[ids])
            inside = int(np.count_nonzero((data[ends[:-1]] & 0xC0) == 0x80)) if len(ids) else 0
            return (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(), inside)
        return one

    schema = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint"
    return (docs.select(docs[id_col].alias("doc_id"),
                        row_udf(schema, make)(docs[text_col]).alias("_r"))
            .select("doc_id", "_r.*"))
