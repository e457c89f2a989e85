"""Byte-level BPE with a sentencepiece model written from a rank file.

Each token's bytes are mapped to printable characters, one for one; the mapped pieces with the negative rank as
score, an identity normaliser and no dummy prefix make a BPE model, serialised here field by field. Text is cut
by the pattern into pre-tokens; a pre-token that is a token is that token, every other is merged by
sentencepiece, thousands in one call with a separator that no merge goes over. Decoding maps pieces back to bytes. The model, of the vocabulary's size, is broadcast; each task
reads its own rows and nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pattern for whose pre-tokens a space before anything but white space always begins a new one
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Spaces that don't begin a pre-token with what follows; spaces that do.
_UNSAFE = regex.compile(r" (?:\s|\Z)").search
_CUT = regex.compile(r" (?=\S)").split
#: Characters of text whose new words are merged in one call, about; longest word that is remembered; characters of
#: words that a worker remembers, beyond which it starts anew.
AT_ONCE, LONGEST_KEPT, REMEMBERED = 1 << 16, 64, 6_000_000
MERGED_AT_ONCE = 4096
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Between pre-tokens that are merged in one call: no piece has it, so no merge goes over it.
_SEPARATOR, _SEPARATOR_BYTE = "‖", b"\xff"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next code point from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64, space, rank a line) in the order of their ranks, which must run from 0."""
    with open(path, "rb") as f:
        found = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [rank for rank, _ in found] != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in found]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is token i, byte-mapped; the unknown piece comes last."""
    chars = byte_characters()
    pieces = [_field(1, "".join(chars[b] for b in token)) + _field(2, float(-rank)) + _field(3, 1) for rank, token in enumerate(tokens)]
    pieces.append(_field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder of one task. Encodings are 4 bytes an id, little-endian. What texts are cut into is merged once while it is remembered."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        self.tokens, self.pre_tokens = tokens, regex.compile(pattern).findall
        self.spaced = pattern == SPACED_PATTERN
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        # UTF-8 has no byte 0xFF
        self.chars = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())} | {chr(0xFF): _SEPARATOR})
        self.whole = {token: i.to_bytes(4, "little") for i, token in enumerate(tokens)}
        self.known: dict[str, bytes] = {}  # pieces of text and pre-tokens
        self.fresh: list[str] = []
        self.held = 0

    def _merged(self, parts: list[bytes]) -> Iterator[bytes]:
        """Encodings of pre-tokens that aren't tokens, many by one call."""
        for at in range(0, len(parts), MERGED_AT_ONCE):
            some = parts[at : at + MERGED_AT_ONCE]
            ids = np.array(self.model.encode(_SEPARATOR_BYTE.join(some).decode("latin-1").translate(self.chars)), "<u4")
            ends = np.append(np.flatnonzero(ids == len(self.tokens)) * 4, len(ids) * 4).tolist()
            data, begin = ids.tobytes(), 0
            for end in ends:
                yield data[begin:end]
                begin = end + 4

    def _split(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; a word with punctuation after it needs no search."""
        if self.spaced:
            word = piece.rstrip(_PUNCTUATION)
            if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
                return [word, piece[len(word) :]] if len(word) < len(piece) else [word]
        return self.pre_tokens(piece)

    def _learn(self, pieces: list[str]) -> None:
        """Adds the encodings of pieces of text, each cut into pre-tokens by itself, and of these to what is known."""
        split = list(map(self._split, pieces))
        new = list(dict.fromkeys(p for pre in split for p in pre if p not in self.known))
        data = [p.encode("utf-8", "surrogatepass") for p in new]
        found = list(map(self.whole.get, data))
        merged = self._merged([d for d, ids in zip(data, found, strict=True) if ids is None])
        self.known.update(zip(new, (next(merged) if ids is None else ids for ids in found), strict=True))
        self.known.update((piece, b"".join(map(self.known.__getitem__, pre))) for piece, pre in zip(pieces, split, strict=True) if len(pre) > 1)
        self.fresh += new
        self.fresh += pieces

    def _pieces(self, text: str) -> list[str]:
        """Pieces that are encoded each by itself: for SPACED_PATTERN a new one begins with each space before anything but white space."""
        if not self.spaced or not text:
            return [text] if text else []
        first, *rest = _CUT(text) if _UNSAFE(text) else text.split(" ")
        rest = [" " + x for x in rest]
        return [first, *rest] if first else rest

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """The encoding of each text; about AT_ONCE characters are looked at together."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            cut = [self._pieces(t) for t in texts[at:to]]
            self._learn(list(set(itertools.filterfalse(self.known.__contains__, itertools.chain.from_iterable(cut)))))
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))
            for piece in self.fresh:
                if len(piece) > LONGEST_KEPT:
                    self.known.pop(piece, None)
                else:
                    self.held += len(piece)
            self.fresh.clear()
            if self.held > REMEMBERED:
                self.known, self.held = {}, 0
            at = to

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The coder of this worker process, by the digest of its model; tasks that follow each other share what it remembers.
_KEPT: dict[str, ByteBpe] = {}


def kept_coder(digest: str, shared) -> ByteBpe:
    if digest not in _KEPT:
        _KEPT.clear()
        _KEPT[digest] = ByteBpe(*shared.value)
    return _KEPT[digest]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, array<int>, on request) for each row of docs (doc_id, text; others are ignored).

    Digests: of the ids as little-endian unsigned 32-bit integers, and of the bytes that they decode to. A null
    text counts as empty: no ids. Repeated rows each get their row; no rows give no rows. ranks_path is read by the driver alone.
    """
    tokens = read_ranks(ranks_path)
    model = serialise_model(tokens)
    digest = hashlib.sha256(model + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((tokens, model, pattern))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = kept_coder(digest, shared)
        for texts in parts:
            rows = []
            for ids in coder.encode_many([text or "" for text in texts]):
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").tolist()) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + keep_ids])

    udf = F.pandas_udf(run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
    return docs.select("doc_id", udf(F.col("text")).alias("e")).select("doc_id", "e.*")


def op6_query(spark, sf_dir: str) -> DataFrame:
    """All documents, by the public ranks for many languages."""
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
