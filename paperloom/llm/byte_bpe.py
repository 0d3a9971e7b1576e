"""Byte-level BPE by a rank file, with the tokenizers library over Arrow batches: ids, character offsets, and decoding of whole and cut sequences."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.batches import text_steps, tidied

#: White space of Unicode (fixed values). A character that is none, followed by one that is, always ends a match of the pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII signs (fixed values): where one follows a letter or number, a match of the pattern ends too.
SIGNS = r"!-/:-@\[-`{-~"
#: Pieces that are encoded in one string, as each starts with white space and ends with none.
JOINED = 256
#: Characters of pieces that a task remembers before it forgets them and starts anew; it bounds memory, not the result.
STORE_CHARS = 8_000_000


def shown_bytes() -> list[str]:
    """The printable character that stands for each byte: visible Latin-1 stays, the other bytes follow from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a file of base64 token and rank, one a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


class RankedTokenizer:
    """A tokenizers-library BPE that gives what merging by rank gives.

    Ranks say which token a merge makes, not of which two: any two tokens whose bytes make a third may merge, the lowest
    rank first. So each token brings a merge for every way to cut it into two tokens, in order of rank, and a match that is
    a token itself is not merged at all. Bytes travel as printable characters, one each.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        letters = shown_bytes()
        shown = {token: "".join(map(letters.__getitem__, token)) for token in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.core = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.core.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        size = 1 + max(ranks.values(), default=0)
        self.tokens = [b""] * size
        for i, token in ((self.core.token_to_id(s), s) for s in shown.values()):
            self.tokens[i] = bytes(map(self.byte_of.__getitem__, token))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        width = len(str(size)) + 1
        self.digits = np.frombuffer("".join(f"{i},".ljust(width) for i in range(size)).encode(), np.uint8).reshape(size, width)
        self.digits_used = self.digits != 32
        # Letters end where a sign follows; anything else goes on to the next white space.
        self.pieces = re.compile(rf"[{WHITE}]*+[^\W\d_]++(?![^{SIGNS}{WHITE}])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.white = re.compile(f"[{WHITE}]")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.ids, self.starts = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        if self.held > STORE_CHARS:
            self._forget()
        white = self.white.match
        led = [p for p in new if white(p) and not white(p[-1])]
        rest = [p for p in new if not white(p) or white(p[-1])]
        rows = [led[i : i + JOINED] for i in range(0, len(led), JOINED)]
        got = [np.array(e.ids, np.int32) for e in self.core.encode_batch_fast(["".join(r) for r in rows] + rest, add_special_tokens=False)]
        counts = []
        for row, ids in zip(rows, got):
            ends = np.cumsum([len(p.encode()) for p in row])
            counts.append(np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends), prepend=-1))
        counts = np.concatenate([*counts, np.fromiter(map(len, got[len(rows) :]), np.int64, len(rest))]).astype(np.int64)
        self.known.update(zip(led + rest, range(len(self.known), len(self.known) + len(new))))
        self.held += sum(map(len, new)) + 16 * len(new)
        self.ids = np.concatenate([self.ids, *got])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Pieces that a match never goes beyond are encoded once for all texts that hold them."""
        cut = [self.pieces.findall(t) for t in texts]
        wanted = set().union(*cut)
        new = [p for p in wanted if p not in self.known]
        if new:
            if self.held > STORE_CHARS:  # all that these texts hold is learnt anew
                new = list(wanted)
            self._learn(new)
        out = []
        for pieces in cut:
            k = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
            low, n = self.starts[k], self.starts[k + 1] - self.starts[k]
            out.append(self.ids[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
        return out

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each token starts and ends in the text, in code points; a token that holds a part of a character spans it whole."""
        ends = np.cumsum(self.lengths[ids])
        begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        character = np.cumsum(begins) - 1  # of each byte
        return character[ends - self.lengths[ids]], character[ends - 1] + 1

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; ids that are no token have none."""
        return b"".join([self.tokens[i] for i in ids.tolist() if 0 <= i < len(self.tokens)])

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.digits[ids][self.digits_used[ids]].tobytes()[:-1]


def whole_characters(raw: bytes) -> tuple[bytes, bytes]:
    """raw without the character that its end may cut, and that character's first bytes, which the next part goes on with."""
    for back in range(1, min(3, len(raw)) + 1):
        b = raw[-back]
        if b >= 0xC0:
            return (raw[:-back], raw[-back:]) if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else (raw, b"")
        if b < 0x80:
            break
    return raw, b""


def encode(docs: DataFrame, ranks_path: str, *, id_column: str = "doc_id", text_column: str = "text", tokens: bool = False) -> DataFrame:
    """Encodes every text and decodes it again: id, n_tokens, ids_sha256, decoded_sha256, n_split; if asked for, ids, starts and ends.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded bytes; n_split counts tokens that hold
    only a part of some character. starts and ends are each token's code points in its text. Special tokens are none: their
    strings are ordinary text. Row by row, without a shuffle; what a task remembers is bounded, and a text is worked on
    whole. A null text is empty: no tokens and the hashes of nothing. Repeated rows and null ids stay as they are; other
    columns are left out; an empty table gives an empty result. The path must exist on the executors.
    """
    more = ["ids", "starts", "ends"] * tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = RankedTokenizer(ranks_path)
        for b in batches:
            for low, high, texts in text_steps(b.column(1)):
                n, a, d, split, lists = [], [], [], [], []
                for text, x in zip(texts, t.encode([text.decode("utf-8") for text in texts])):
                    n.append(len(x))
                    a.append(hashlib.sha256(t.decimal(x)).hexdigest())
                    d.append(hashlib.sha256(t.raw(x)).hexdigest())
                    begins = (np.frombuffer(text + b"\0", np.uint8) & 0xC0) != 0x80
                    ends = np.cumsum(t.lengths[x])
                    split.append(int((~(begins[ends] & begins[ends - t.lengths[x]])).sum()))
                    if tokens:
                        lists.append([x, *(o.astype(np.int32) for o in t.offsets(text, x))])
                cells = [b.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(split, pa.int64())]
                yield pa.RecordBatch.from_arrays(cells + [pa.array([x[k] for x in lists], pa.list_(pa.int32())) for k in range(len(more))], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", *more])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(tidied(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long" + "".join(f", {c} array<int>" for c in more))
    return out.withColumnRenamed("id", id_column)


def decode(sequences: DataFrame, ranks_path: str, *, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id and text of rows of ids. Bytes that are no UTF-8, such as a character of which one row holds a part alone, become U+FFFD.

    Null ids give a null text, no ids an empty one; an id that is no token, or is null, has no bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = RankedTokenizer(ranks_path)
        for b in batches:
            texts = [None if x is None else t.raw(np.array([-1 if i is None else i for i in x], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = sequences.select(sequences[id_column].alias("id"), sequences[ids_column].cast("array<long>").alias("ids"))
    return rows.mapInArrow(tidied(run), f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_column)


def decode_parts(parts: DataFrame, ranks_path: str, *, key_column: str = "doc_id", order_column: str = "start", ids_column: str = "ids") -> DataFrame:
    """key, order and text of the parts of cut sequences, each with whole characters alone.

    A character that lies across a cut is given to the part that ends it; the texts of a sequence's parts, in order, make
    the text of the whole. At the end of a sequence what is left of a character becomes U+FFFD. Parts of a null key are one
    sequence; equal orders keep no certain order. Parts are read in order, one at a time, so no sequence is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = RankedTokenizer(ranks_path)
        rest = b""
        for b in batches:
            texts = []
            for x, first, last in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                raw = (b"" if first else rest) + t.raw(np.array([-1 if i is None else i for i in x or ()], np.int64))
                raw, rest = (raw, b"") if last else whole_characters(raw)
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["key", "order", "text"])

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    of = Window.partitionBy("key").orderBy("order")
    rows = parts.select(parts[key_column].alias("key"), parts[order_column].alias("order"), parts[ids_column].cast("array<long>").alias("ids"))
    rows = rows.select("key", "order", "ids", F.lag(F.lit(0), 1, 1).over(of).alias("first"), F.lead(F.lit(0), 1, 1).over(of).alias("last"))  # each key's parts follow each other
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("key", "order"))
    return rows.mapInArrow(tidied(run), f"{kinds}, text string").withColumnsRenamed({"key": key_column, "order": order_column})
