"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkwell.llm.common import free_name
from inkwell.llm.shingles import slices

#: Sizes of the tables of steps, states and pairs of tokens, as powers of two, each filled to half; full ones start anew, which changes no result.
STEP_BITS, STATE_BITS, PAIR_BITS = 20, 20, 20
#: Configurations that may be kept before the tables start anew.
MOST_LIVING = 1 << 21
#: Pieces of more bytes are encoded in portions of so many; bytes of pieces that are encoded side by side.
LOOKAHEAD, PORTION, SEGMENT = 4096, 1 << 16, 64
#: Texts are split into pieces so many bytes at a time, longer ones so many matches at a time.
AT_ONCE, CHUNK = 1 << 21, 1 << 16
START = -1
_SPREAD, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class Table:
    """64-bit keys to 32-bit values in one array of a fixed size, open-addressed; looked up and filled many at a time."""

    def __init__(self, bits: int):
        self.shift, self.mask, self.most = np.uint64(64 - bits), (1 << bits) - 1, 1 << bits - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.size = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._home(keys)
        held, out = self.keys[at], self.values[at]
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            out[left] = self.values[at[left]]
            held = self.keys[at[left]]
            left = left[(held != keys[left]) & (held != -1)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys, none of which is here or comes twice."""
        self.size += len(keys)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            place = at[left]
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[left[free]]
            done = free & (self.keys[place] == keys[left])  # of several that want one place the last one has it
            self.values[place[done]] = values[left[done]]
            left = left[~done]
            at[left] = at[left] + 1 & self.mask


class Vocabulary:
    """The tokens of a rank file; a token's id is its rank, and lower ranks merge first.

    left, right: the two tokens that merge last to make a token, -1 for a byte; real: whether merging its bytes gives it.
    """

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.left, self.right, self.real = np.full(len(self.tokens), -1, np.int64), np.full(len(self.tokens), -1, np.int64), self.sizes == 1
        cuts = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        a, b, whole = (np.array(x, np.int64) for x in zip(*cuts, strict=True)) if cuts else (np.zeros(0, np.int64),) * 3
        self.merges = Table(max(4, (2 * len(cuts)).bit_length()))
        self.merges.put(a << 32 | b, whole.astype(np.int32))
        for size in np.unique(self.sizes[whole]):
            own = np.flatnonzero(self.sizes[whole] == size)
            own = own[self._fit(a[own], b[own], whole[own])]
            self.left[whole[own]], self.right[whole[own]], self.real[whole[own]] = a[own], b[own], True
        self.pairs = Table(PAIR_BITS)

    def _fit(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of two tokens, by ranks below bound alone, gives just these two.

        Undoes the merges within both, the latest first. At each point a merge across the border that ranks before the one
        just undone would have come first, and then the two were never made.
        """
        fits = self.real[left] & self.real[right]
        at = np.flatnonzero(fits)
        left, right, bound = left[at], right[at], bound[at]
        while len(at):
            across = self.merges.get(left << 32 | right)
            bad = (across >= 0) & (across < bound)
            fits[at[bad]] = False
            inner_left, inner_right = self.left[left] >= 0, self.left[right] >= 0
            more = ~bad & (inner_left | inner_right)
            at, left, right, bound, inner_left, inner_right = (x[more] for x in (at, left, right, bound, inner_left, inner_right))
            # of two equal ranks the one to the left merges first, so the one to the right is undone first
            undo = inner_left & ((left > right) | ~inner_right)
            left, right, bound = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right]), np.where(undo, left, right + 1)
        return fits

    def adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens can stand side by side."""
        pairs = left << 32 | right
        known = self.pairs.get(pairs)
        if len(new := np.unique(pairs[known < 0])):
            if self.pairs.size + len(new) > self.pairs.most:
                self.pairs.clear()
            made = self._fit(new >> 32, new & 0xFFFFFFFF, np.full(len(new), len(self.tokens)))
            if len(new) <= self.pairs.most:
                self.pairs.put(new, made.astype(np.int32))
            known[known < 0] = made[np.searchsorted(new, pairs[known < 0])]
        return known > 0


class Transducer:
    """Bytes to tokens from left to right, one step a byte, many pieces side by side.

    The machine to determinise guesses where tokens end: its configuration is a place in the trie of tokens and the token
    before it. A guess survives only if neighbouring tokens are adjacent() to each other; then just one way of cutting the
    bytes so far survives to any token end, which is the one that merging gives. A determinised state is the list of living
    configurations, the longest one first; its output is the token that ends there. A configuration dies when no token goes
    on as its bytes do, so at most the longest token's bytes are looked ahead: tokens on which all living ones agree are
    emitted. States and steps are made when first reached, and kept in arrays of fixed bounds.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        nodes, ends, inner = {b"": 0}, [-1], [True]
        edges: list[int] = []
        for rank, token in enumerate(vocabulary.tokens):
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    edges.append(nodes[token[: k - 1]] << 8 | token[k - 1])
                    inner[nodes[token[: k - 1]]] = True
                    nodes[token[:k]] = len(ends)
                    ends.append(-1)
                    inner.append(False)
            if token:
                ends[nodes[token]] = rank
        self.ends, self.inner = np.array(ends, np.int64), np.array(inner, bool)
        self.depth = np.array([len(x) for x in nodes], np.int64)
        self.trie = Table(max(4, (2 * len(edges)).bit_length()))
        self.trie.put(np.array(edges, np.int64), np.arange(1, len(ends), dtype=np.int32))
        self.steps, self.numbers = Table(STEP_BITS), Table(STATE_BITS)
        self.begins, self.output = np.zeros(self.numbers.most + 2, np.int64), np.full(self.numbers.most + 1, -1, np.int32)
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        self.steps.clear()
        self.numbers.clear()
        self.count, self.node, self.before = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self._states(np.zeros(1, np.int64), np.full(1, START, np.int64), np.array([0, 1]))

    def _states(self, node: np.ndarray, before: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The numbers of states of which each has the configurations from one begin to the next; the last one is at a token's end."""
        size = np.diff(begins)
        place = np.arange(len(node)) - np.repeat(begins[:-1], size)
        spread = (node << 32 | before & 0xFFFFFFFF).view(np.uint64) * _SPREAD + place.astype(np.uint64)
        key = (np.add.reduceat((spread ^ spread >> _HALF) * _SPREAD, begins[:-1]).view(np.int64)) & 0x7FFFFFFFFFFFFFFF
        out = self.numbers.get(key)
        held = np.flatnonzero(out >= 0)
        out[held[~_equal(self.node, self.before, self.begins[out[held]], self.begins[out[held] + 1], node, before, begins[held], begins[held + 1])]] = -1
        new = np.flatnonzero(out < 0)
        _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
        twin = new[first][back]  # states of one hash that differ, if that ever happens, get numbers of their own
        own = (twin == new) | ~_equal(node, before, begins[twin], begins[twin + 1], node, before, begins[new], begins[new + 1])
        kept = new[own]
        rows = _ranges(begins[kept], size[kept])
        at = int(self.begins[self.count])
        while at + len(rows) > len(self.node):
            self.node, self.before = (np.concatenate((x, np.zeros_like(x))) for x in (self.node, self.before))
        self.node[at : at + len(rows)], self.before[at : at + len(rows)] = node[rows], before[rows]
        numbers = (self.count + np.arange(len(kept))).astype(np.int32)
        self.begins[numbers + 1] = at + np.cumsum(size[kept])
        self.output[numbers] = before[begins[kept + 1] - 1]
        self.count += len(kept)
        out[kept] = numbers
        out[new] = np.where(own, out[new], out[twin])
        named = kept[(self.numbers.get(key[kept]) < 0) & np.isin(kept, twin)]
        self.numbers.put(key[named], out[named])
        return out

    def _made(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states that steps not yet known lead to."""
        size = self.begins[states + 1] - self.begins[states]
        rows = _ranges(self.begins[states], size)
        owner = np.repeat(np.arange(len(states)), size)
        to = self.trie.get(self.node[rows].astype(np.int64) << 8 | byte[owner]).astype(np.int64)
        live = to >= 0
        to, owner, before = to[live], owner[live], self.before[rows[live]].astype(np.int64)
        ends = np.flatnonzero(self.ends[to] >= 0)
        token, prior = self.ends[to[ends]], before[ends]
        good = self.vocabulary.real[token]
        inside = np.flatnonzero(prior != START)
        good[inside] = self.vocabulary.adjacent(prior[inside], token[inside])
        ends, token = ends[good], token[good]
        on = np.flatnonzero(self.inner[to])
        # behind the configurations that go on stands the one at a token's end
        order = np.argsort(np.concatenate((2 * owner[on], 2 * owner[ends] + 1)), kind="stable")
        node, before = np.concatenate((to[on], np.zeros(len(ends), np.int64)))[order], np.concatenate((before[on], token))[order]
        begins = np.searchsorted(np.concatenate((owner[on], owner[ends]))[order], np.arange(len(states) + 1))
        return self._states(node, before, begins)

    def step(self, states: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one byte more; states may be forgotten only by room(), between pieces."""
        keys = states.astype(np.int64) << 8 | byte
        out = self.steps.get(keys)
        if len(missing := np.flatnonzero(out < 0)):
            new, back = np.unique(keys[missing], return_inverse=True)
            made = self._made(new >> 8, new & 0xFF)
            self.steps.put(new, made)
            out[missing] = made[back]
        return out

    def room(self, steps: int) -> bool:
        """Whether so many more steps surely fit in the tables."""
        return self.count + steps < self.numbers.most and self.steps.size + steps < self.steps.most and self.begins[self.count] < MOST_LIVING

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces, one after another, and how many each has."""
        short = [p for p in pieces if len(p) <= LOOKAHEAD]
        found = [self._side_by_side(some) for some in _portions(short, PORTION)]
        if len(short) == len(pieces):
            return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        parts, at = [], 0
        flat, count = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        ends, k, sizes = np.cumsum(count), 0, []
        for p in pieces:
            if len(p) <= LOOKAHEAD:
                parts.append(flat[at : ends[k]])
                at, k = int(ends[k]), k + 1
            else:
                parts.append(np.concatenate(list(self.stream(p))))
            sizes.append(len(parts[-1]))
        return np.concatenate(parts).astype(np.int32), np.array(sizes)

    def _side_by_side(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        if not self.room(len(data)):
            self.reset()
        begin = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        living = len(pieces) - np.searchsorted(np.sort(size), np.arange(1, int(size.max(initial=0)) + 1))
        last = np.zeros(len(data), np.int32)  # the token that ends at each byte
        state = np.zeros(len(pieces), np.int32)
        for k, n in enumerate(living.tolist()):
            at = begin[order[:n]] + k
            state = self.step(state[:n], data[at].astype(np.int64))
            last[at] = self.output[state]
        # back from each piece's end over the tokens that all agree on
        end, owner = begin + size, np.flatnonzero(size)
        out, owners, place = [], [], end[owner]
        while len(owner):
            token = last[place - 1]
            out.append(token)
            owners.append(owner)
            place = place - self.vocabulary.sizes[token]
            on = place > begin[owner]
            owner, place = owner[on], place[on]
        if not out:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        whose = np.concatenate(owners)
        # later rounds come first within a piece
        turned = np.argsort(whose[::-1], kind="stable")
        return np.concatenate(out)[::-1][turned], np.bincount(whose, minlength=len(pieces))

    def stream(self, piece: bytes) -> Iterator[np.ndarray]:
        """The tokens of one long piece; after every LOOKAHEAD bytes those are emitted on which all living configurations agree."""
        state, done, known = np.zeros(1, np.int32), 0, {}
        last: list[int] = []  # the token that ends at each byte from done on
        for begin in range(0, len(piece), LOOKAHEAD):
            part = piece[begin : begin + LOOKAHEAD]
            if not self.room(4 * len(part)):
                node, before = self._living(int(state[0]))
                self.reset()
                known, state = {}, self._states(node, before, np.array([0, len(node)]))
            self._explore(part, known)
            now = int(state[0])
            for byte in part:
                key = now << 8 | byte
                if (to := known.get(key)) is None:
                    to = known[key] = int(self.step(np.array([now]), np.array([byte]))[0])
                now = to
                last.append(int(self.output[now]))
            state = np.array([now], np.int32)
            ends = [len(last)] if begin + LOOKAHEAD >= len(piece) else (len(last) - self.depth[self._living(now)[0]]).tolist()
            while len(set(ends)) > 1:  # back to where all ways meet
                ends.remove(most := max(ends))
                ends.append(most - len(self.vocabulary.tokens[last[most - 1]]))
            tokens, at = [], ends[0]
            while at > 0:
                tokens.append(last[at - 1])
                at -= len(self.vocabulary.tokens[tokens[-1]])
            yield np.array(tokens[::-1], np.int32)
            del last[: ends[0]]

    def _explore(self, part: bytes, known: dict[int, int]) -> None:
        """Makes known, side by side, most steps that part takes: places in a text soon come to the same state wherever one begins."""
        data, begins = np.frombuffer(part, np.uint8).astype(np.int64), np.arange(0, len(part), SEGMENT)
        states = np.zeros(len(begins), np.int32)
        for k in range(2 * SEGMENT):
            begins = begins[: np.searchsorted(begins, len(part) - k)]
            byte = data[begins + k]
            keys = states[: len(begins)].astype(np.int64) << 8 | byte
            states = self.step(states[: len(begins)], byte)
            known.update(zip(keys.tolist(), states.tolist(), strict=True))

    def _living(self, state: int) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(int(self.begins[state]), int(self.begins[state + 1]))
        return self.node[rows].astype(np.int64), self.before[rows].astype(np.int64)


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... and so on, sizes[i] of each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


def _equal(node, before, low, high, others_node, others_before, others_low, others_high) -> np.ndarray:
    """Whether the configurations from low to high are those from others_low to others_high, in each place."""
    same = high - low == others_high - others_low
    which = np.flatnonzero(same)
    size = (high - low)[which]
    a, b = _ranges(low[which], size), _ranges(others_low[which], size)
    same[np.repeat(which, size)[(node[a] != others_node[b]) | (before[a] != others_before[b])]] = False
    return same


def _portions(pieces: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Pieces in runs of about `most` bytes."""
    some, held = [], 0
    for p in pieces:
        some.append(p)
        held += len(p)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


#: The well-formed UTF-8 sequences; first byte from, to; range of the second byte; bytes after it.
UTF8 = (
    (0x00, 0x7F, None, 0), (0xC2, 0xDF, (0x80, 0xBF), 0), (0xE0, 0xE0, (0xA0, 0xBF), 1), (0xE1, 0xEC, (0x80, 0xBF), 1), (0xED, 0xED, (0x80, 0x9F), 1),
    (0xEE, 0xEF, (0x80, 0xBF), 1), (0xF0, 0xF0, (0x90, 0xBF), 2), (0xF1, 0xF3, (0x80, 0xBF), 2), (0xF4, 0xF4, (0x80, 0x8F), 2),
)


def _machine() -> list[dict[int, int]]:
    """Transitions by state and byte; state 0: between characters. A byte without a transition is ill-formed there."""
    steps: list[dict[int, int]] = [{}]
    rest = {0: 0}
    for n in (1, 2):
        steps.append({b: rest[n - 1] for b in range(0x80, 0xC0)})
        rest[n] = len(steps) - 1
    for low, high, second, more in UTF8:
        to = 0
        if second:
            steps.append({b: rest[more] for b in range(second[0], second[1] + 1)})
            to = len(steps) - 1
        steps[0].update(dict.fromkeys(range(low, high + 1), to))
    return steps


class Decoder:
    """Token ids to text, chunk after chunk; the bytes of an unfinished character wait for the next chunk.

    An ill-formed sequence becomes U+FFFD, once for each maximal part of a character.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.machine = tokens, _machine()
        self._steps: dict[tuple[int, int], int] = {}
        self.whole = np.array([self._run(0, t) == 0 for t in tokens])

    def _run(self, state: int, part: bytes) -> int:
        for byte in part:
            state = self.machine[state].get(byte, -1)
            if state < 0:
                return -1
        return state

    def _step(self, state: int, token: int) -> int:
        key = (state, token)
        if (to := self._steps.get(key)) is None:
            to = self._steps[key] = self._run(state, self.tokens[token])
        return to

    def _repaired(self, data: bytes) -> tuple[str, bytes]:
        out, begin, state = [], 0, 0
        at = 0
        while at < len(data):
            to = self.machine[state].get(data[at], -1)
            if to >= 0:
                state, at = to, at + 1
                if state == 0:
                    out.append(data[begin:at].decode())
                    begin = at
                continue
            at += state == 0
            out.append("\ufffd")
            begin, state = at, 0
        return "".join(out), data[begin:]

    def stream(self, chunks: Iterable[np.ndarray]) -> Iterator[str]:
        state, waits = 0, b""
        for ids in chunks:
            data = waits + b"".join(map(self.tokens.__getitem__, ids.tolist()))
            at, odd = 0, np.flatnonzero(~self.whole[ids]) if state == 0 else np.arange(len(ids))
            for i in odd.tolist():  # in state 0 whole tokens leave the state as it is
                if i < at:
                    continue
                at = i
                while at < len(ids):
                    state = self._step(state, int(ids[at]))
                    at += 1
                    if state <= 0:
                        break
                if state < 0:
                    break
            if state < 0:
                text, waits = self._repaired(data)
                state = self._run(0, waits)
            else:
                cut = len(data)
                while state and (data[cut - 1] & 0xC0) == 0x80:
                    cut -= 1
                cut -= state > 0
                text, waits = data[:cut].decode(), data[cut:]
            yield text
        if waits:
            yield "\ufffd"

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.stream(ids[i : i + CHUNK] for i in range(0, len(ids), CHUNK)))


class Codec:
    """Encoding and decoding of texts; every match of pattern is encoded by itself."""

    def __init__(self, path: str, pattern: str):
        self.pattern, self.vocabulary = regex.compile(pattern), Vocabulary(path)
        self.transducer, self.decoder = Transducer(self.vocabulary), Decoder(self.vocabulary.tokens)

    def _ids(self, found: list[list[str]]) -> list[np.ndarray]:
        """The ids of texts that are split into pieces; equal pieces are encoded once."""
        number = dict.fromkeys(chain.from_iterable(found))
        for i, piece in enumerate(number):
            number[piece] = i
        flat, count = self.transducer.encode([p.encode() for p in number])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        which = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        begins = np.cumsum(count) - count
        ids = flat[_ranges(begins[which], count[which])].astype("<u4")
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(count[which])))[np.cumsum(sizes)]
        return np.split(ids, ends[:-1]) if len(ends) else []

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if sum(map(len, texts)) <= 2 * AT_ONCE:
            return self._ids([self.pattern.findall(t) for t in texts])
        out = []
        for text in texts:
            matches, parts = (m.group() for m in self.pattern.finditer(text)), [np.zeros(0, "<u4")]
            while pieces := list(islice(matches, CHUNK)):
                parts += self._ids([pieces])
            out.append(np.concatenate(parts))
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, packed: bytes) -> str:
        return self.decoder.decode(np.frombuffer(packed, "<u4"))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, ids: str | None = None) -> DataFrame:
    """docs without text, with n_tokens, ids_sha256 and decoded_sha256; with the ids themselves (array<int>) in a column of the name ids.

    A null text counts as empty: no tokens, the digests of nothing. Whole texts are encoded, row by row, without a shuffle; of
    equal rows each one is, and an empty table stays empty. Other columns pass as they are; those named like an output give way.
    path must exist on every worker.
    """
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    outputs = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        outputs.append(T.StructField(ids, T.ArrayType(T.IntegerType())))
    kept = [c for c in docs.columns if c != text and c not in {f.name for f in outputs}]
    schema = T.StructType([docs.schema[c] for c in kept] + outputs)

    body = free_name("__text", docs.columns)

    def run(batches):
        own = Codec(path, pattern)  # a task's own, so that a worker holds its tables, some 50 MB, no longer than it encodes
        for batch in batches:
            for begin, texts in slices(batch.column(body), AT_ONCE):
                found = own.encode_all([t or "" for t in texts.to_pylist()])
                made = [
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(own.decoder.decode(x).encode()).hexdigest() for x in found], pa.string()),
                ]
                if ids:
                    made.append(pa.array([x.view("<i4") for x in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(begin, len(texts)) for c in kept] + made, [f.name for f in schema.fields])

    return docs.select(*kept, docs[text].alias(body)).mapInArrow(run, schema)
