"""Offset-preserving SentencePiece encoding, and decoding.

The text is normalised as the model asks: its compiled character map (a double-array trie over UTF-8 bytes with
replacement strings) is searched for the longest prefix at every place, and each normalised byte keeps the
original byte it came from. The pieces that the library finds are then projected through that alignment to
byte spans of the original text. Where a model's map is empty, as that of ``piece_bpe_32k.model`` is, every
character stands for itself and only spaces change; the alignment and the projection are the same.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .packing import tokenizer_path

META = "▁"  # stands for a space in pieces
META_BYTES = META.encode()


class CharsMap:
    """A compiled character map: 4 bytes length, a double-array trie of 4-byte units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size :] if blob else b""
        #: Bytes that some key starts with.
        self.starts = np.zeros(256, dtype=bool)
        if self.units:
            root = self._offset(self.units[0])
            self.starts[[c for c in range(1, 256) if root ^ c < len(self.units) and self.units[root ^ c] & ((1 << 31) | 0xFF) == c]] = True

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that starts at ``at``."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if (unit & ((1 << 31) | 0xFF)) != data[i]:
                break
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                found = (i + 1 - at, self.units[node] & ((1 << 31) - 1))
        if found is None:
            return None
        end = self.replacements.index(b"\0", found[1])
        return found[0], self.replacements[found[1] : end]


class OffsetCodec:
    """Encodes texts to ids with byte spans, exactly as the library does without begin or end ids.

    Where no piece of the model joins a character with a space behind it and texts keep their spaces, a text
    may be cut before each single space; such segments are remembered, up to ``most`` of them.
    """

    def __init__(self, name: str, most: int = 300_000, longest: int = 64):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(tokenizer_path(name), "rb") as f:
            data = f.read()
        proto.ParseFromString(data)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec = proto.normalizer_spec
        self.chars = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.is_byte = [p.type == pb.ModelProto.SentencePiece.BYTE for p in proto.pieces]
        joins = any(META in p.piece.lstrip(META) for p in proto.pieces if p.type in (1, 4))
        self.by_segment = self.dummy and self.escape and not (self.squeeze or self.suffix or joins or self.chars.units)
        self.n_bytes = np.array([1 if b else len(p.piece.encode()) for b, p in zip(self.is_byte, proto.pieces)])
        self.unk_id = self.sp.unk_id()
        self.cache: dict[str, tuple] = {}
        self.most, self.longest = most, longest

    def mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes with the longest keys of the map replaced, original byte of each, whether a piece has only spaces up to it)."""
        raw = np.frombuffer(data, dtype=np.uint8)
        out, source, lead = [], [], []
        done = 0

        def plain(upto: int) -> None:
            out.append(raw[done:upto])
            # the bytes of a character all come from its first byte
            at = np.arange(done, upto)
            head = (raw[done:upto] & 0xC0) != 0x80
            source.append(at[head][np.cumsum(head) - 1] if len(at) else at)
            lead.append(raw[done:upto] == 32)

        for i in np.flatnonzero(self.chars.starts[raw]).tolist() if self.chars.units else ():
            if i >= done and (got := self.chars.longest(data, i)):
                plain(i)
                new = np.frombuffer(got[1], dtype=np.uint8)
                out.append(new)
                source.append(np.full(len(new), i))
                lead.append(np.cumsum(new != 32) == 0)
                done = i + got[0]
        plain(len(data))
        return np.concatenate(out), np.concatenate(source), np.concatenate(lead)

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte it comes from."""
        data = text.encode()
        end = len(data)
        out, source, lead = self.mapped(data)
        if self.squeeze and len(out):
            space = out == 32
            after = np.r_[True, space[:-1]]
            last = len(out) - int(np.argmin(space[::-1])) if not space.all() else 0
            keep = ~(space & lead & after)
            keep[last:] = False
            out, source = out[keep], source[keep]
        if not len(out):
            return out, np.array([end])
        if self.dummy:
            out = np.r_[out, np.uint8(32)] if self.suffix else np.r_[np.uint8(32), out]
            source = np.r_[source, end] if self.suffix else np.r_[source[0], source]
        if self.escape:
            times = np.where(out == 32, len(META_BYTES), 1)
            wide = np.repeat(out, times)
            first = np.cumsum(times) - times
            for k, c in enumerate(META_BYTES):
                wide[first[out == 32] + k] = c
            out, source = wide, np.repeat(source, times)
        return out, np.r_[source, end]

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """As ``align``, in plain types."""
        out, source = self.align(text)
        return out.tobytes(), source.tolist()

    def project(self, text: str, ids: list[int]) -> np.ndarray:
        """Byte spans in the original text, a row (start, end) per piece; together they leave no gap but what squeezing drops."""
        if not ids:
            return np.zeros((0, 2), dtype=np.int64)
        _, source = self.align(text)
        sizes = self.n_bytes[ids]
        if self.unk_id in ids:
            # an unknown piece may stand for any characters
            sizes = np.array([1 if self.is_byte[i] else len(p.encode()) for i, p in zip(ids, self.sp.encode(text, out_type=str))])
        ends = np.minimum(np.cumsum(sizes), len(source) - 1)
        return np.stack([source[np.r_[0, ends[:-1]]], source[ends]], axis=1)

    def _learn(self, words: set[str]) -> dict[str, tuple]:
        """word -> (ids, ids as text); encoded in one call."""
        new = list(words)
        got = {w: (ids, ",".join(map(str, ids))) for w, ids in zip(new, self.sp.encode(new, num_threads=1))}
        self.cache.update((w, x) for w, x in got.items() if len(w) <= self.longest)
        return got

    def ids_of(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """(ids, ids as text) of each text: by segments where these can be told apart, else whole."""
        if len(self.cache) > self.most:
            self.cache.clear()
        cut_up = [None if not self.by_segment or not t or t[0] == " " or t[-1] == " " or "  " in t or META in t else t.split(" ") for t in texts]
        known = self.cache
        fresh = self._learn({w for words in cut_up if words for w in words if w not in known})
        for text, words in zip(texts, cut_up):
            if words is None:
                ids = self.sp.encode(text)
                yield ids, ",".join(map(str, ids))
            else:
                parts = [known.get(w) or fresh[w] for w in words]
                yield list(chain.from_iterable([p[0] for p in parts])), ",".join([p[1] for p in parts])

    def encode(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """(ids, byte spans) of a whole text; null as empty."""
        text = text or ""
        ((ids, _),) = self.ids_of([text])
        return ids, [tuple(x) for x in self.project(text, ids).tolist()]

    def digest(self, texts: list[str]) -> Iterator[tuple[int, str, str, int, int]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text, bytes inside spans, CRC-32 of the spans) of each text."""
        for text, (ids, line) in zip(texts, self.ids_of(texts)):
            spans = self.project(text, ids)
            covered = int((spans[:, 1] - spans[:, 0]).sum())
            yield len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(self.sp.decode(ids).encode()).hexdigest(), covered, zlib.crc32(spans.astype("<u4").tobytes())


def encode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text") -> DataFrame:
    """``docs`` with ids, starts, ends added: pieces with original byte spans. Null and empty texts have none."""

    @F.pandas_udf("ids array<int>, starts array<int>, ends array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = OffsetCodec(model)
        for texts in batches:
            got = [codec.encode(t) for t in texts]
            yield pd.DataFrame({"ids": [g[0] for g in got], "starts": [[s for s, _ in g[1]] for g in got], "ends": [[e for _, e in g[1]] for g in got]})

    return docs.withColumn("__codec", run(F.col(text_col))).select(*[c for c in docs.columns if c not in ("ids", "starts", "ends")], "__codec.*")


def decode_documents(docs: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids") -> DataFrame:
    """``docs`` with decoded added: the text that the ids stand for; null ids give an empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = OffsetCodec(model)
        for ids in batches:
            yield pd.Series([codec.sp.decode([] if x is None else [int(i) for i in x]) for x in ids])

    return docs.withColumn("decoded", run(F.col(ids_col)))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and of the pieces' byte spans covered (their bytes) and spans_crc32 (little-endian unsigned 32-bit starts and ends) per document."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, covered long, spans_crc32 long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = OffsetCodec("piece_bpe_32k.model")
        for texts in batches:
            rows = [r for at in range(0, len(texts), 256) for r in codec.digest([t or "" for t in texts[at : at + 256]])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "covered", "spans_crc32"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", run("text").alias("x")).select("doc_id", "x.*")


SQL: dict[str, str] = {}
