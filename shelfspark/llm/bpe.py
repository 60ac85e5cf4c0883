"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

The ranks compile into a byte trie and the relation "two tokens may stand side by side" (the merges of their joined bytes
give back just these two). A sequence of tokens is the BPE encoding of its bytes exactly when all neighbours are
related, so each prefix of a piece has one last token, and reading a byte only needs the still open tokens. A state of the
transducer is the set of open tokens: (trie node, token before it, tokens decided since all open ones last agreed). Its
moves are built once it has been left LAZY times by bytes it had no move for; until then, and once MAX_STATES are built,
the rest of a piece runs on the open tokens themselves. A token is emitted as soon as every open token agrees on it: a lookahead bounded by the longest
token. Finished words are kept in a table of bounded size, emptied when full.

The decoder turns ids into text chunk by chunk; its state is the incomplete character at the end of the bytes so far.

Null text counts as empty and has no tokens; repeated rows, null ids and extra columns change nothing; an empty table
gives an empty result. Texts are read whole; long ones are split into pieces one at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import text_or_empty

ROOT, NONE = 0, -1
MAX_STATES, LAZY, MAX_WORDS, LONG_TEXT, CHUNK = 50_000, 3, 250_000, 1 << 20, 4096


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """Encodes bytes. ``encode`` is a run from the start state; ``step`` and ``end`` are the transducer itself."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {v: k for k, v in ranks.items()}
        #: A trie node is (its children by byte, its token or NONE, its number); the root has number 0.
        self.nodes = [({}, NONE, ROOT)]
        for word, rank in ranks.items():
            kids = self.nodes[ROOT][0]
            for b in word[:-1]:
                kids = self._node(kids, b)[0]
            kids_of, _, number = self._node(kids, word[-1])
            kids[word[-1]] = self.nodes[number] = (kids_of, rank, number)
        #: For each token, and NONE at the start of a piece, which tokens may follow it; filled as needed.
        self.follows: dict[int, dict[int, bool]] = {t: {} for t in (NONE, *self.token)}
        self.states = [((ROOT, NONE, ()),)]
        self.number = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, tuple]]] = [{}]
        self.missed = [LAZY]  # how often a state lacked a move; the start builds its moves at once

    def _node(self, kids: dict, byte: int) -> tuple:
        if byte not in kids:
            kids[byte] = ({}, NONE, len(self.nodes))
            self.nodes.append(kids[byte])
        return kids[byte]

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied one by one, lowest rank first. Only used on pairs of tokens, to compile the relation."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _related(self, a: int, b: int) -> bool:
        left, right = self.token[a] if a != NONE else b"", self.token[b]
        known = self.follows[a][b] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple]:
        """(next state, tokens emitted). Open tokens stand with the longest first."""
        last, still = None, []
        for at, before, decided in self.states[state]:
            node = self.nodes[at][0].get(byte)
            if node is None:
                continue
            kids, t, at = node
            if last is None and t >= 0:
                ok = self.follows[before].get(t)
                if ok or ok is None and self._related(before, t):
                    last = (ROOT, t, (*decided, t))
            if kids:
                still.append((at, before, decided))
        still.append(last)
        if len(still) == 1:
            emitted = last[2]
            key = ((ROOT, last[1], ()),)
        else:
            emitted = still[0][2]  # the common start of what is decided
            for item in still:
                decided = item[2]
                while decided[:len(emitted)] != emitted:
                    emitted = emitted[:-1]
                if not emitted:
                    break
            if n := len(emitted):
                still = [(node, before, decided[n:]) for node, before, decided in still]
            key = tuple(still)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.missed.append(0)
        move = self.moves[state][byte] = (to, emitted)
        return move

    def end(self, state: int) -> tuple:
        return self.states[state][-1][2]

    def encode(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        out: list[int] = []
        state, moves = 0, self.moves
        for i, byte in enumerate(data):
            move = moves[state].get(byte)
            if move is None:
                if self.missed[state] < LAZY or len(self.states) >= MAX_STATES:
                    self.missed[state] += 1
                    return (*out, *self._simulate(state, data[i:]))
                move = self.step(state, byte)
            state, emitted = move
            if emitted:
                out += emitted
        return (*out, *self.end(state))

    def _simulate(self, state: int, data: bytes) -> list[int]:
        """The same moves without building states: the open tokens' decided ones are linked lists."""
        nodes, follows = self.nodes, self.follows
        root, items = nodes[ROOT][0], []
        for at, before, decided in self.states[state]:
            link = None
            for t in decided:
                link = (link, t)
            items.append((nodes[at][0], before, follows[before], link))
        for byte in data:
            last, still = None, []
            for kids, before, after, link in items:
                node = kids.get(byte)
                if node is None:
                    continue
                kids, t, _ = node
                if last is None and t >= 0:
                    ok = after.get(t)
                    if ok or ok is None and self._related(before, t):
                        last = (root, t, follows[t], (link, t))
                if kids:
                    still.append((kids, before, after, link))
            still.append(last)
            items = still
        out, link = [], items[-1][3]
        while link:
            link, t = link
            out.append(t)
        return out[::-1]


#: A single space between other characters always begins a piece: the pattern lets it lead what follows.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def blocks(text: str) -> Iterator[str]:
    """The text cut at boundaries into parts of about LONG_TEXT characters, so that a long text is never split whole."""
    start = 0
    while len(text) - start > LONG_TEXT and (m := BOUNDARY.search(text, start + LONG_TEXT)):
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


class Encoder:
    """Texts to ids: the pattern's matches, each by the transducer. Finished words are remembered with their ids.

    ``words``: texts may be cut at single spaces and words remembered, which holds for public_tokenizers.PATTERN only.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: bool = False):
        self.transducer, self.pattern, self.by_words = Transducer(ranks), regex.compile(pattern), words
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the words before the last clearing: frequent ones come back from here

    def _pieces(self, text: str) -> tuple[int, ...]:
        encode = self.transducer.encode
        if text[1:].isalpha() and text[0] == " ":  # letters throughout: one piece
            return encode(text.encode())
        found = self.pattern.findall(text) if len(text) < LONG_TEXT else (m[0] for m in self.pattern.finditer(text))
        return tuple(chain.from_iterable(encode(piece.encode()) for piece in found))

    def _remember(self, word: str) -> tuple[int, ...]:
        if word[-1] in ",." and (stem := word[:-1]).isalpha():  # a mark alone is a piece of its own
            return (self.words.get(stem) or self._remember(stem)) + (self.transducer.ranks[word[-1].encode()],)
        ids = self.older.get(word) or self._pieces(" " + word)
        if len(word) <= 64:
            if len(self.words) >= MAX_WORDS:
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> array:
        ids, words = array("I"), self.words
        if not self.by_words:
            for m in self.pattern.finditer(text):
                ids.extend(self.transducer.encode(m[0].encode()))
            return ids
        for block in blocks(text):
            first, *rest = BOUNDARY.split(block)
            ids.extend(self._pieces(first))
            got = list(map(words.get, rest))
            if None in got:
                for i, known in enumerate(got):
                    if known is None:  # unless an earlier word of this block was the same
                        got[i] = words.get(rest[i]) or self._remember(rest[i])
            ids.extend(chain.from_iterable(got))
        return ids


class Utf8:
    """Incremental UTF-8: the state is the incomplete character at the end, at most three bytes."""

    def __init__(self):
        self.tail = b""

    def feed(self, data: bytes) -> str:
        data = self.tail + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            b = data[-back]
            if b >= 0xC0:  # a lead byte: is its character whole?
                if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                    cut -= back
                break
            if b < 0x80:
                break
        self.tail = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        tail, self.tail = self.tail, b""
        return tail.decode("utf-8", "replace")


def decode(ids: Iterable[int], token: dict[int, bytes], chunk: int = CHUNK) -> Iterator[str]:
    """The text of ``ids`` in pieces of ``chunk`` ids; no character is torn apart between pieces."""
    state, i = Utf8(), 0
    while part := ids[i:i + chunk]:
        yield state.feed(b"".join(map(token.__getitem__, part)))
        i += chunk
    yield state.end()


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(data: bytes, pattern: str, words: bool) -> Encoder:
    """One encoder for each worker process, so that its tables outlive a task."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data), pattern, words)
    return _ENCODERS[key]


def _runner(ranks, pattern: str, make):
    from public_tokenizers import PATTERN  # on the driver only: workers get the answer

    words = pattern == PATTERN

    def run(batches):
        encoder = _encoder(ranks.value, pattern, words)
        for batch in batches:
            yield from make(encoder, batch)
        encoder.words.clear()  # the trie and its moves stay with the worker; the words would only take memory from later stages
        encoder.older.clear()
    return run


def _ids(encoder: Encoder, batch: pa.RecordBatch):
    for i in range(batch.num_rows):  # one row at a time: a batch of long texts has far more ids than characters in memory
        ids = np.frombuffer(encoder.encode(batch.column(1)[i].as_py()), dtype=np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["id", "ids"])


def _digests(encoder: Encoder, batch: pa.RecordBatch):
    n, first, second = [], [], []
    for text in batch.column(1):
        ids = encoder.encode(text.as_py())
        n.append(len(ids))
        first.append(hashlib.sha256(np.frombuffer(ids, dtype=np.uint32).astype("<u4").tobytes()).hexdigest())
        back = hashlib.sha256()
        for part in decode(ids, encoder.transducer.token):
            back.update(part.encode())
        second.append(back.hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)],
                                     ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _apply(df: DataFrame, make, columns: str, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whose size does not follow the data
    rows = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_runner(ranks, pattern, make), f"id {kind}, {columns}").withColumnRenamed("id", id_col)


def encode_rows(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each row's text."""
    return _apply(df, _ids, "ids array<int>", path, pattern, id_col, text_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""
    return _apply(df, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, pattern, id_col, text_col)
