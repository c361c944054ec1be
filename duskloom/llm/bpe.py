"""Byte-level BPE by dynamic programming over prefixes, and its decoding.

BPE gives every prefix of a piece exactly one last token. An automaton over the vocabulary lists the tokens that end at
a position; of these just one is compatible with the last token of the prefix before it. Stored for each prefix, these
last tokens are back-pointers that spell the exact ids. A pair of tokens is compatible when BPE over their joined bytes
gives the same two tokens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: How the byte-level pre-tokenizer cuts a text (a fixed value of the format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers, and the longest of them in characters.
CACHED_PIECES = 250_000
CACHED_LENGTH = 64
#: Pairs of tokens whose compatibility a worker remembers.
CACHED_PAIRS = 250_000


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> its ids; what isn't remembered is worked out."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self._work = work

    def __missing__(self, piece: str) -> bytes:
        found = self._work(piece)
        if len(piece) <= CACHED_LENGTH:
            self[piece] = found
        return found


class BytePairs:
    """A byte-level BPE vocabulary: encode(text) -> ids as little-endian unsigned 32-bit bytes; decode(ids) -> text."""

    def __init__(self, spec: str):
        """spec: the JSON of a byte-level BPE file of the tokenizers library."""
        data = json.loads(spec)
        cut = data.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or data.get("normalizer") or data["model"].get("type", "BPE") != "BPE" or data["model"].get("ignore_merges"):
            raise ValueError("not a byte-level BPE file that cuts texts by the usual pattern")
        vocab: dict[str, int] = data["model"]["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
        self._rank = {(vocab[x], vocab[y]): r for r, (x, y) in enumerate(pairs)}
        self._letters, self._space = byte_letters(), byte_letters()[32]
        self._coded = {t: t.to_bytes(4, "little") for t in vocab.values()}
        parts = {vocab[x + y]: (vocab[x], vocab[y], r) for r, (x, y) in reversed([*enumerate(pairs)])}
        first = {t: self._spine(t, parts, 0) for t in vocab.values()}
        last = {t: self._spine(t, parts, 1) for t in vocab.values()}
        self._first, self._last = first, last
        self._agree: dict[int, dict[int, bool]] = {}
        self._pairs = 0
        self._words = ahocorasick.Automaton()
        single = set(byte_letters().values())
        for word, t in vocab.items():
            if word in single or (t in parts and self._stays(t, parts)):
                self._words.add_word(word, (t, len(word)))
        self._words.make_automaton()
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self._added = {k: np.uint32(v).astype("<u4").tobytes() for k, v in added.items()}
        self._cut = regex.compile("(" + "|".join(regex.escape(k) for k in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._pieces = regex.compile(PIECES)
        back = {c: b for b, c in byte_letters().items()}
        self._bytes = {t: bytes(back[c] for c in w) for w, t in vocab.items() if all(c in back for c in w)} | {v: k.encode() for k, v in added.items()}
        self._known = _Pieces(self._piece)

    @staticmethod
    def _spine(token: int, parts: dict, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end while BPE builds token, the largest first, each with the rank at which it is merged away."""
        out, until = [(token, float("inf"))], None
        while token in parts:
            until, token = parts[token][2], parts[token][side]
            out.append((token, until))
        return out

    def _stays(self, token: int, parts: dict) -> bool:
        """Whether BPE over the token's own bytes gives the token: both halves do, and none of their ends merge earlier than they do."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in parts:
                x, y, rank = parts[t]
                if not self._apart(x, y, rank):
                    return False
                todo += [x, y]
        return True

    def _apart(self, x: int, y: int, before: float = float("inf")) -> bool:
        """Whether no merge of lower rank than before crosses the border between x and y. Of equal ranks the left place merges first."""
        for a, a_gone in self._last[x]:
            for b, b_gone in self._first[y]:
                rank = self._rank.get((a, b))
                if rank is not None and rank < before and rank < a_gone and rank <= b_gone:
                    return False
        return True

    def _fits(self, before: int, token: int) -> bool:
        """Whether two tokens are compatible; remembered by the second."""
        self._pairs += 1
        if self._pairs > CACHED_PAIRS:
            self._agree, self._pairs = {}, 0
        found = self._agree.setdefault(token, {})[before] = self._apart(before, token)
        return found

    def _piece(self, piece: str) -> bytes:
        word = piece.replace(" ", self._space) if piece.isascii() and piece.isprintable() else "".join(map(self._letters.__getitem__, piece.encode()))
        last = [-1] * (len(word) + 1)  # the last token of each prefix
        size = last.copy()
        agree, none = self._agree.get, {}
        for end, (token, n) in self._words.iter(word):
            if last[end + 1] < 0:
                if at := end + 1 - n:
                    if last[at] < 0:
                        continue
                    ok = agree(token, none).get(last[at])
                    if ok is None:
                        ok = self._fits(last[at], token)
                    if not ok:
                        continue
                last[end + 1], size[end + 1] = token, n
        ids, at = [], len(word)
        while at:
            if last[at] < 0:
                raise ValueError(f"no token ends at byte {at} of {piece!r}")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return b"".join(map(self._coded.__getitem__, ids))

    def _ordinary(self, text: str) -> bytes:
        return b"".join(map(self._known.__getitem__, self._pieces.findall(text)))

    def encode(self, text: str) -> bytes:
        if len(self._known) > CACHED_PIECES:
            self._known.clear()
        if not any(k in text for k in self._added):
            return self._ordinary(text)
        return b"".join(self._added[p] if i % 2 else self._ordinary(p) for i, p in enumerate(self._cut.split(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(spec: str) -> BytePairs:
    return BytePairs(spec)


def _with_spec(docs: DataFrame, path: str) -> Callable[[], BytePairs]:
    """What gives executors the vocabulary: the driver reads the file (its size doesn't depend on the data) and broadcasts it."""
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    return lambda: _loaded(spec.value)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids array<int>), one row per row: the ids that the tokenizers library gives for the whole text.

    Null counts as empty; no text gives no ids. Strings of added tokens become their ids. path: a byte-level BPE file of
    the tokenizers library.
    """
    tables = _with_spec(docs, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = tables().encode
        ids = [np.frombuffer(encode(t or ""), "<i4") for t in batch.column("text").to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())
        return pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), flat)})

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text): bytes that aren't UTF-8 become U+FFFD; a null list counts as empty."""
    tables = _with_spec(encoded, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = tables().decode
        return pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array([decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()], pa.string())})

    return map_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), work, "doc_id long, text string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, then decode from the ids: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded text is the text).

    One row per row; null counts as empty. The SHA-256 is of the ids as little-endian unsigned 32-bit integers, and of
    the decoded text in UTF-8.
    """
    tables = _with_spec(docs, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = tables()
        count, coded, plain, same = [], [], [], []
        for text in batch.column("text").to_pylist():
            ids = own.encode(text or "")
            back = own.decode(ids)
            count.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            plain.append(hashlib.sha256(back.encode()).hexdigest())
            same.append(back == (text or ""))
        return pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(coded, pa.string()), "decoded_sha256": pa.array(plain, pa.string()), "round_trip": pa.array(same, pa.bool_())})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)
