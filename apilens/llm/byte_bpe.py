"""Byte-level BPE: encoding by backtracking from longest matches, and decoding.

Token bytes are mapped to Latin-1, one character per byte, for an Aho-Corasick
automaton. A piece's longest token at each place comes from one pass of the
automaton; from left to right the longest is tried, then its longest proper
prefix that is a token, and so on. A token may follow another only if merging
their joint bytes by rank gives exactly these two (memoised per pair); places
from which nothing fits are marked, so none is tried twice. The sequence found
is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from apilens.llm.common import map_arrow, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NEVER = 1 << 60
PAIR_MEMO = 1 << 18  # pairs that a worker remembers: about 25 MB
PIECE_MEMO = 3 << 15  # pieces of each of two generations: about 35 MB
PIECE_MEMO_CHARS = 64
MET = 1 << 21  # places of the table by which a piece met before is told from a new one: 2 MB


def _first_plane(pattern: str) -> re.Pattern:
    """The same pattern for texts of the first plane, its classes spelt out: ``re`` is twice as fast on those."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def spelt(name: str) -> str:
        runs = [m.span() for m in regex.finditer(f"{name}+", plane)]
        return "".join(f"\\u{ord(plane[a]):04x}-\\u{ord(plane[z - 1]):04x}" for a, z in runs)

    classes = {name: spelt(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    inside = lambda m: re.sub(r"\\p\{[LN]\}|\\s", lambda x: classes[x[0]], m[0])
    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    out = re.sub(r"(?<!\\)\\S", lambda _: f"[^{classes[chr(92) + 's']}]", out)
    return re.compile(re.sub(r"\\p\{[LN]\}|\\s", lambda x: f"[{classes[x[0]]}]", out))


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.plane = _first_plane(pattern)
        self.token_bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token_bytes[i] = b
        self.size = [len(b) for b in self.token_bytes]
        self.follows: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met = bytearray(MET)
        # Tokens that merging never forms from their own bytes can only be whole pieces.
        formed, self.parts = {}, {}
        for b, i in ranks.items():
            ids, before = self._merged(b)
            if ids == [i]:
                formed[b] = i
                if before:
                    self.parts[i] = before
        if any(max(two) >= i for i, two in self.parts.items()):
            raise ValueError("a token's parts must have lower ranks than the token")
        self.automaton = ahocorasick.Automaton()
        for b, i in formed.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {i: next((formed[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in formed), -1) for b, i in formed.items()}

    def _merged(self, data: bytes) -> tuple[list[int], list[int]]:
        """Merging one token's own bytes by rank: the ids it ends with, and those before the last merge."""
        parts, before, ranks = [data[i : i + 1] for i in range(len(data))], [], self.ranks
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            before = parts[:]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts], [ranks[p] for p in before]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of two tokens ends with these two.

        Both are taken apart again, the one formed later first. If what then
        meets at the border could have merged before the next step of either
        (at equal rank, before the right one's), that merge would have come first.
        """
        u, v, u_next, v_next, text = left, right, NEVER, NEVER, self.token_bytes
        while True:
            rank = self.ranks.get(text[u] + text[v], NEVER)
            if rank < u_next and rank <= v_next:
                return False
            if u in self.parts and (u > v or v not in self.parts):
                u, u_next = self.parts[u][1], u
            elif v in self.parts:
                v, v_next = self.parts[v][0], v
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        known = self.follows.get(left << 32 | right)
        if known is None:
            if len(self.follows) >= PAIR_MEMO:
                self.follows.clear()
            known = self._stay_apart(left, right)
            self.follows[left << 32 | right] = known
        return known

    def piece_ids(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n, size, shorter, follows, fits = len(data), self.size, self.shorter, self.follows.get, self._fits
        longest = [-1] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            at = end - size[i] + 1
            if (now := longest[at]) < 0 or size[now] < size[i]:
                longest[at] = i
        open_, out, at, token, last = bytearray(b"\1") * (n + 1), [], 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + size[token]
                if open_[end] and (last < 0 or (follows(last << 32 | token) or fits(last, token))):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else -1
            else:  # nothing fits from here after what stands before: take that back, try what is shorter
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]
        return out

    def _piece(self, piece: str) -> bytes:
        if (found := self.older.get(piece)) is None:
            found = struct.pack(f"<{len(ids := self.piece_ids(piece.encode()))}I", *ids)
        # Most distinct pieces come once: only one met before (or that shares its place with one) is remembered.
        if self.met[at := hash(piece) % MET] == 0:
            self.met[at] = 1
        elif len(piece) <= PIECE_MEMO_CHARS and len(self.pieces) < 2 * PIECE_MEMO:
            self.pieces[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if len(self.pieces) >= PIECE_MEMO:  # what is in use comes back from the older generation
            self.older, self.pieces = self.pieces, {}
        get, slow = self.pieces.get, self._piece
        pattern = self.plane if text.isascii() or max(text) <= "\uffff" else self.pattern
        return b"".join([get(p) or slow(p) for p in pattern.findall(text)])

    def forget(self) -> None:
        """Drops what is remembered of pieces and pairs."""
        self.pieces, self.older, self.follows, self.met = {}, {}, {}, bytearray(MET)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per worker process; built where it is first used."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids and the columns to ``keep``; one row per input row.

    ``vocabulary`` names a file of public_tokenizers or is a path that every
    executor can open. Each match of the pattern is encoded separately, without
    special tokens. Null texts count as empty: no ids, and the digests of
    nothing; very long texts are read whole. Ids of rows may be null or
    repeated; the rows stay apart. An empty table gives an empty result. Other
    columns aren't read.
    """
    pattern = pattern or public_tokenizers.PATTERN
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *[docs[c] for c in keep or []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        bpe = tokenizer(vocabulary if os.sep in vocabulary else public_tokenizers.path(vocabulary), pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                ids, counts, first, second = [], [], [], []
                for text in texts.slice(at, 256).to_pylist():
                    encoded = bpe.encode(text or "")
                    counts.append(len(encoded) // 4)
                    first.append(sha(encoded))
                    second.append(sha(bpe.decode(encoded)))
                    if with_ids:
                        ids.append(np.frombuffer(encoded, dtype="<u4").astype(np.int32))
                arrays = [batch.column(0).slice(at, 256), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                arrays, names = [*arrays, *[c.slice(at, 256) for c in batch.columns[2:]]], [*names, *(keep or [])]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        bpe.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep or [])
    return map_arrow(rows, run, schema + ", ids array<int>" * with_ids + kept)


def op7_byte_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
