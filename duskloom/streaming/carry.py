"""The carry buffer of a streamed reply: text is let through as far as no token can still be open at its end.

A stream is a numbered row of frames. Its state is what each of its blocks holds back, and the frames that came too early: frames are taken in
the order of their numbers, whichever file or micro-batch brings them, and a number that was seen is skipped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.unmask import TOKEN

LONGEST = 63
#: Silence after which a stream counts as broken off: what it holds is let out.
SILENCE_S = 300

_TAIL = re.compile(r"\[[A-Z0-9_a-f]*\Z")
_TOKEN = re.compile(TOKEN)
_QUOTED = re.compile(rf'"({TOKEN})"(\s*)')
_STRING = re.compile(r'(?:[^"\\]|\\.)*', re.S)


def held_tail(buffer: Column) -> Column:
    """What must be held back: from the last '[' on, while it can still become a token."""
    tail = F.regexp_extract(buffer, r"\[[A-Z0-9_a-f]*\z", 0)
    return F.when(F.length(tail) <= LONGEST, tail).otherwise("")


def split_safe(buffer: str) -> tuple[str, str]:
    """(what may go out, what must be held)."""
    tail = _TAIL.search(buffer)
    if tail is None or len(tail[0]) > LONGEST:
        return buffer, ""
    return buffer[: tail.start()], tail[0]


class Held(NamedTuple):
    """What a block holds back: its kind, the text, whether the text begins inside a JSON string, whether nothing but white space came before;
    and length and checksum of all that came in."""

    kind: str = "text"
    text: str = ""
    inside: bool = False
    blank: bool = True
    length: int = 0
    check: int = 0


#: Text to let out, and whether it is a token that is the whole value of a JSON string, or of the block.
Piece = tuple[str, bool]


def _maybe_token(text: str) -> bool:
    return text == "" or split_safe(text) == ("", text) or _TOKEN.fullmatch(text) is not None


def raw_json(text: str, inside: bool, blank: bool, final: bool) -> tuple[list[Piece], str, bool, bool]:
    """Raw JSON text -> pieces, the text to hold, whether it begins inside a string, and whether only white space was let out.

    A string is held from its opening quote while its content may become a single token, and behind its closing quote until it is clear
    that it isn't a key. A lone token that is all there is of a block is held until the block ends.
    """
    out: list[Piece] = []

    def let(part: str, whole: bool = False) -> None:
        if part and out and not whole and not out[-1][1]:
            out[-1] = (out[-1][0] + part, False)
        elif part:
            out.append((part, whole))

    bare = text.strip()
    if blank and not inside and bare and _maybe_token(bare):
        if not final:
            return out, text, False, True
        if _TOKEN.fullmatch(bare):
            at = text.index(bare)
            return [p for p in ((text[:at], False), (bare, True), (text[at + len(bare) :], False)) if p[0]], "", False, False
    at = 0
    while at < len(text):
        if inside:
            end = _STRING.match(text, at).end()
            if end < len(text) and text[end] == '"':
                let(text[at : end + 1])
                at, inside = end + 1, False
                continue
            safe = split_safe(text[at:end])[0] if end == len(text) else text[at:end]
            let(text[at:] if final else safe)
            return out, "" if final else text[at + len(safe) :], True, False
        quote = text.find('"', at)
        if quote < 0:
            safe = text[at:] if final else split_safe(text[at:])[0]
            let(safe)
            at += len(safe)
            break
        let(text[at:quote])
        lone = _QUOTED.match(text, quote)
        if lone and (final or lone.end() < len(text)):
            key = text[lone.end() : lone.end() + 1] == ":"
            let('"')
            let(lone[1], not key)
            let('"')
            at = lone.end(1) + 1
        elif not final and (lone or _maybe_token(text[quote + 1 :])):
            at = quote
            break
        else:
            let('"')
            at, inside = quote + 1, True
    rest = text[at:]
    return out, rest, inside, blank and not rest.strip() and not "".join(p for p, _ in out).strip()


def taken(held: Held, kind: str | None, text: str, final: bool) -> tuple[list[Piece], Held]:
    """A block with more text, or at its end -> what may go out, and what it holds then."""
    kind = kind or held.kind
    length, check = held.length + len(text), crc32(text.encode("utf-8", "surrogatepass"), held.check)
    if kind == "input_json":
        out, rest, inside, blank = raw_json(held.text + text, held.inside, held.blank, final)
        return out, Held(kind, rest, inside, blank, length, check)
    safe, rest = (held.text + text, "") if final else split_safe(held.text + text)
    return [(safe, False)] * bool(safe), Held(kind, rest, False, False, length, check)


OUTPUT = "stream_id string, seq long, ord int, block string, kind string, text string, whole boolean, agrees boolean"
_STATE = "state string"


class Stream:
    """A stream's state between micro-batches."""

    def __init__(self, saved: str | None = None):
        own = json.loads(saved) if saved else {}
        self.next, self.ended, self.last = own.get("next", 0), own.get("ended", False), own.get("last", 0)
        self.early: dict[int, list] = {int(k): v for k, v in own.get("early", {}).items()}
        self.blocks = {k: Held(*v) for k, v in own.get("blocks", {}).items()}

    def saved(self) -> str:
        return json.dumps({"next": self.next, "ended": self.ended, "last": self.last, "early": self.early, "blocks": self.blocks})

    def _end(self, block: str | None, seq: int) -> Iterator[tuple]:
        """Let out what a block holds, and the calls of a choice with it; of all blocks for null."""
        for name in [b for b in self.blocks if block is None or b == block or b.startswith(f"{block}t")]:
            held = self.blocks[name]
            pieces, self.blocks[name] = taken(held, None, "", True)
            yield from ((seq, name, held.kind, text, whole, None) for text, whole in pieces)

    def _frame(self, seq: int, pieces: list[dict]) -> Iterator[tuple]:
        for p in pieces:
            block, text = p.get("block"), p.get("text") or ""
            if p.get("whole_text"):
                yield from self._end(block, seq)
                held = self.blocks.get(block, Held())
                same = (held.length, held.check) == (len(text), crc32(text.encode("utf-8", "surrogatepass")))
                yield seq, block, "done_json" if p.get("kind") == "input_json" else "done_text", text, False, same
                continue
            if block is not None and text:
                out, self.blocks[block] = taken(self.blocks.get(block, Held()), p.get("kind"), text, False)
                yield from ((seq, block, self.blocks[block].kind, t, whole, None) for t, whole in out)
            if p.get("end"):
                yield from self._end(block, seq)
                self.ended = self.ended or block is None

    def advance(self, drain: bool = False) -> Iterator[tuple]:
        """Frames in the order of their numbers, up to the first that is missing; draining, all of them, and what is held."""
        while not self.ended and (self.next in self.early or drain and self.early):
            self.next = self.next if self.next in self.early else min(self.early)
            yield from self._frame(self.next, self.early.pop(self.next))
            self.next += 1
        if drain and not self.ended:
            yield from self._end(None, self.next)
        if self.ended or drain:
            self.early, self.blocks, self.ended = {}, {}, True


def joined(rows: list[tuple]) -> list[tuple]:
    """Rows of a stream with those of a block that follow each other in one, where none has a token; a row with one stays as it is, so that few texts
    are looked up."""
    out: list[list] = []
    last: dict[str, list | None] = {}
    for seq, block, kind, text, whole, agrees in rows:
        plain, own = not whole and agrees is None and not _TOKEN.search(text), last.get(block)
        if plain and own is not None and own[2] == kind:
            own[3].append(text)
            continue
        out.append([seq, block, kind, [text], whole, agrees])
        last[block] = out[-1] if plain else None
    return [(seq, block, kind, "".join(texts), whole, agrees) for seq, block, kind, texts, whole, agrees in out]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    own = Stream(state.get[0] if state.exists else None)
    if state.hasTimedOut:
        out = list(own.advance(drain=True))
        state.remove()
    else:
        for frame in frames:
            for seq, at, pieces in zip(frame["seq"], frame["at"], frame["pieces"], strict=True):
                own.last = max(own.last, int(pd.Timestamp(at).timestamp() * 1000))
                if seq >= own.next and not own.ended:
                    own.early[int(seq)] = json.loads(pieces)
        out = list(own.advance())
        state.update((own.saved(),))
        state.setTimeoutTimestamp(max(own.last + SILENCE_S * 1000, state.getCurrentWatermarkMs() + 1))
    rows = [(*key, seq, i, block, kind, text, whole, agrees) for i, (seq, block, kind, text, whole, agrees) in enumerate(joined(out))]
    yield pd.DataFrame(rows, columns=["stream_id", "seq", "ord", "block", "kind", "text", "whole", "agrees"])


def rechunked(frames: DataFrame) -> DataFrame:
    """A stream of frames (stream_id, seq, at, pieces) as rows of OUTPUT whose texts never cut a token, so that each can be joined with the vault alone.

    pieces: JSON, a list of {block, kind, text, end, whole_text}: text of a block; end: the block ends, or for a null block the stream;
    whole_text: the text is all of the block, and agrees says whether its parts gave the same. seq counts a stream's frames from 0. kind is text,
    compaction or input_json. whole marks tokens that are the whole value of a JSON string in raw JSON. A stream that is silent for SILENCE_S
    of event time lets out what it holds, each block as its own kind. A task holds the frames of one stream in one micro-batch at once.
    """
    late = frames.withWatermark("at", f"{SILENCE_S} seconds")
    return late.groupBy("stream_id").applyInPandasWithState(_step, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
