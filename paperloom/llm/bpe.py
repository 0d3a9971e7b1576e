"""Byte-level BPE: encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.batches import text_steps, tidied

#: A chunk ends where the rolling hash of the last 16 bytes is 0 in these bits: once in 1,024 bytes on the whole.
CUT_MASK = 0x3FF
#: A cut that follows another within so many bytes is none, so that periodic text is not cut at each byte.
LEAST_CHUNK = 64
#: Bytes of chunks that a task remembers before it forgets them and starts anew; it bounds memory, not the result.
STORE_BYTES = 24_000_000


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, read once for each task."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        # The printable stand-ins that byte-level vocabularies use: visible Latin-1 stays, the other bytes follow from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {x["content"]: x["id"] for x in said["added_tokens"]}
        ranks = {bytes(stand_in[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in special}
        # The ByteLevel pre-tokenizer's pattern (fixed value).
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.path, self.whole, self.special = path, None, special
        self.core = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        size = 1 + max([*ranks.values(), *special.values()])
        self.tokens = [b""] * size
        for token, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
            self.tokens[i] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        width = len(str(size)) + 1
        self.digits = np.frombuffer("".join(f"{i},".ljust(width) for i in range(size)).encode(), np.uint8).reshape(size, width)
        self.digits_used = self.digits != 32

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a text, as the tokenizers library gives them without special tokens added."""
        s = text.decode("utf-8")
        try:
            return self.core.encode_to_numpy(s, allowed_special="all").astype(np.uint32, copy=False)
        except BaseException as e:  # its pattern engine gives up on endless white space with a panic, which is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(s, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; byte sequences that are none become U+FFFD."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace").encode("utf-8")

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.digits[ids][self.digits_used[ids]].tobytes()[:-1]


def cuts(buf: np.ndarray) -> np.ndarray:
    """Where content-defined chunks end in a buffer: after bytes at which a rolling hash of 16 bytes has its low bits 0, on character boundaries."""
    table = np.random.RandomState(20).randint(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
    h = table[buf]
    for back in (1, 2, 4, 8):
        h[back:] = h[back:] + (h[:-back] << np.uint32(back))
    at = np.flatnonzero(((h >> np.uint32(9)) & np.uint32(CUT_MASK)) == 0) + 1
    at = at[at < len(buf)]
    at = at[(buf[at] & 0xC0) != 0x80]
    return at[np.diff(at, prepend=-LEAST_CHUNK) >= LEAST_CHUNK]


class ChunkEncoder:
    """Encodes texts from chunks that are encoded once for all the texts that share them.

    A cut at a rolling-hash position may fall inside a word, so tokens near it can be wrong. White space after a visible
    ASCII character always starts a new pre-token, whatever surrounds it; such places are where a chunk's own tokens and
    those of the whole text must agree. At each join the text from the last such place before it to the first one after it
    is encoded again, further out where a chunk has none, until both ends agree with token borders of the chunks.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.store, self.held, self.reused, self.encoded = vocabulary, {}, 0, 0, 0

    def chunk(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk and where in it each token ends."""
        got = self.store.get(text)
        if got is None:
            if self.held > STORE_BYTES:
                self.store, self.held = {}, 0
            ids = self.v.encode(text)
            got = self.store[text] = (ids, np.cumsum(self.v.lengths[ids]).astype(np.int32))
            self.held += len(text)
            self.encoded += 1
        else:
            self.reused += 1
        return got

    def batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        raw = b"\n".join([*texts, b""])
        buf = np.frombuffer(raw, np.uint8)
        at = cuts(buf) if len(buf) else np.zeros(0, np.int64)
        solid = (buf > 32) & (buf < 127)
        agree = np.flatnonzero(((buf[1:] == 32) | (buf[1:] == 9) | (buf[1:] == 10) | (buf[1:] == 13)) & solid[:-1]) + 1
        low = 0
        for t in texts:
            high = low + len(t)
            inner = at[np.searchsorted(at, low, "right") : np.searchsorted(at, high, "left")].tolist()
            yield self.text(raw, [low, *inner, high], agree) if inner else self.chunk(t)[0]
            low = high + 1

    def text(self, raw: bytes, edges: list[int], agree: np.ndarray) -> np.ndarray:
        parts, done, last = [], edges[0], len(edges) - 2
        firsts = np.searchsorted(agree, np.array(edges[:-1]) + 1).tolist()
        lasts = (np.searchsorted(agree, np.array(edges[1:])) - 1).tolist()
        for k, (low, high) in enumerate(zip(edges, edges[1:])):
            start = low if k == 0 else int(agree[firsts[k]]) if firsts[k] <= lasts[k] else None
            end = high if k == last else int(agree[lasts[k]]) if firsts[k] <= lasts[k] else None
            if start is None or end is None or end <= start:
                continue  # nothing of this chunk is certain: the join before it reaches further
            ids, ends = self.chunk(raw[low:high])
            i = 0 if start == low else int(np.searchsorted(ends, start - low)) + 1
            j = len(ids) if end == high else int(np.searchsorted(ends, end - low)) + 1
            if (i and ends[i - 1] != start - low) or ends[j - 1] != end - low:
                continue  # the borders don't agree: the join before it reaches further
            if done < start:
                parts.append(self.v.encode(raw[done:start]))
            parts.append(ids[i:j])
            done = end
        if done < edges[-1]:
            parts.append(self.v.encode(raw[done : edges[-1]]))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def encode_decode(docs: DataFrame, vocabulary_path: str, *, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>, if asked for).

    Row by row, without a shuffle; the rolling-hash chunks that texts of one task share are encoded once for them. A null
    text is empty: no tokens and the hashes of nothing. Repeated rows and null ids stay as they are; other columns are
    left out. The vocabulary's path must exist on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(Vocabulary(vocabulary_path))
        v = encoder.v
        for b in batches:
            for low, high, texts in text_steps(b.column(1)):
                n, a, d, lists = [], [], [], []
                for x in encoder.batch(texts):
                    n.append(len(x))
                    a.append(hashlib.sha256(v.decimal(x)).hexdigest())
                    d.append(hashlib.sha256(v.decode(x)).hexdigest())
                    if ids:
                        lists.append(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())] + ([pa.array(lists, pa.list_(pa.int32()))] if ids else []), ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids).withColumnRenamed("id", id_column)
