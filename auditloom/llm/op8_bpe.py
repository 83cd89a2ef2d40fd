"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte of a token maps to one printable character, so a token becomes a piece; its score is its negative rank and
the normaliser is the identity. sentencepiece then merges in rank order, as byte-level BPE does. Pre-tokens are
encoded one by one and decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections import ChainMap
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import table

#: Pre-tokens that a worker remembers; beyond it the memory is emptied, which changes the speed only.
REMEMBERED = 300_000
#: Pre-tokens of one text that are encoded at a time.
BLOCK = 1 << 16


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 bytes stand for themselves, the rest follow U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must run from 0 without a gap."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes after them."""
    letters = byte_characters()
    pieces = [_bytes(1, _bytes(1, "".join(letters[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -i)) for i, t in enumerate(tokens)]
    pieces.append(_bytes(1, _bytes(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens)) + b"".join(_number(k, -1) for k in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + b"".join(_number(k, 0) for k in (3, 4, 5))
    return b"".join(pieces) + _bytes(2, trainer) + _bytes(3, normalizer)


class Codec:
    """Encodes and decodes texts with the ranks of ``tokens`` and the pre-token ``pattern``."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.letters, self.names = byte_characters(), [str(i) for i in range(len(tokens))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.known: dict[str, list[int]] = {}

    def _learn(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct pre-token: its own rank if it is a token, else what the merges give."""
        found, rest = {}, []
        for p in pieces:
            b = p.encode()
            if (rank := self.ranks.get(b)) is not None:
                found[p] = [rank]
            else:
                rest.append((p, "".join(map(self.letters.__getitem__, b))))
        if rest:
            found.update(zip((p for p, _ in rest), self.model.encode([s for _, s in rest], num_threads=1), strict=True))
        return found

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids, in blocks."""
        if len(text) <= BLOCK:
            blocks = iter([self.pattern.findall(text)])
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            blocks = iter(lambda: list(islice(found, BLOCK)), [])
        for pieces in blocks:
            if len(self.known) > REMEMBERED:
                self.known = {}
            known = self.known
            if missing := [p for p in {*pieces} if p not in known]:
                new = self._learn(missing)
                known.update((p, i) for p, i in new.items() if len(p) <= 64)
                if any(len(p) > 64 for p in missing):
                    known = ChainMap(new, known)
            yield list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_last: list = []  # a worker's vocabulary and the codec made of it


def _codec(shared) -> Codec:
    if not _last or _last[0] is not shared.value:
        _last[:] = [shared.value, Codec(*shared.value)]
    return _last[1]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The tokens, broadcast: a vocabulary file has a fixed, checked size."""
    import public_tokenizers

    tokens = read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    if len(tokens) > 1_000_000:
        raise ValueError("a vocabulary of over a million tokens is not broadcast")
    return spark.sparkContext.broadcast((tokens, pattern or public_tokenizers.PATTERN))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``docs(doc_id, text)``; a null text counts as empty and has no ids."""
    shared = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                ids = [list(chain.from_iterable(codec.encode(t or ""))) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, data)``: the bytes that ``ids`` stand for."""
    shared = _vocabulary(encoded.sparkSession, path, None)

    def run(batches):
        tokens = shared.value[0]
        for batch in batches:
            data = [b"".join(tokens[i] for i in ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def encode_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode every whole text and return the digests of both, block by block in bounded memory.

    Nulls: a null text is an empty one (no tokens, digests of nothing); a null doc_id is kept. Very long texts: whole. Ties
    and repeated rows: a row each, with equal results. Empty table: no rows. Other columns are not read.
    """
    shared = _vocabulary(docs.sparkSession, path, pattern)

    def one(codec: Codec, text: str) -> tuple[int, str, str]:
        n, ids_hash, data_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids in codec.encode(text):
            if not ids:
                continue
            ids_hash.update(((b"," if n else b"") + ",".join(map(codec.names.__getitem__, ids)).encode()))
            data_hash.update(codec.decode(ids))
            n += len(ids)
        return n, ids_hash.hexdigest(), data_hash.hexdigest()

    def run(batches):
        codec, last = _codec(shared), (None, None)  # a text and what it gave: rows of one document taken twice follow each other
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = []
                for text in part.column(1).to_pylist():
                    if (text or "") != last[0]:
                        last = text or "", one(codec, text or "")
                    found.append(last[1])
                columns = [part.column(0), *(pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
