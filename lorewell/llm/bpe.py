"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

A BPE encoding can be built from left to right: for every prefix of a piece there is one token that its encoding ends
with, and a token t may follow a token s exactly if the two byte strings joined encode to [s, t].  So a state holds the
longest suffix of the input that some token begins with and, for it and each shorter such suffix, the token that ends
before it: all that decides which tokens can come next.  Reading a byte leads to the next state and writes how long the
token is that the encoding up to this byte ends with.  States and arcs are made when a text first needs them, and the
tables are emptied when they reach a bound, so memory stays bounded.

Tokens are emitted after a bounded lookahead: when as many bytes as two of the longest tokens wait, what the paths of
all suffixes in the state share is settled and leaves.  Every byte of every piece goes through arcs and states; tables
of pieces and units stand before the transducer only as caches of what it gave.

Decoding streams: the bytes of token ids go through an incremental UTF-8 state machine that carries unfinished
sequences over chunk borders; what it does with a whole token from its start state is kept for each token.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, id_and_text
from .units import SPACE_PATTERN, Memo, UnitTable, portions

#: Bounds of what a worker keeps; reaching one empties that table and changes no result.
MAX_STATES = 250_000
MAX_PIECES = 150_000
MAX_PAIRS = 100_000
#: Bytes of text that are cut into units at once.
PORTION = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the token's bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_encode(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """The definition: merge the leftmost pair of lowest rank until none has a rank (below a bound)."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BpeTransducer:
    """Pieces in, token ids out; see the module's docstring.

    States are numbers, and an arc is one too: arcs[state << 8 | byte] = next state << 8 | length of the last token, which
    is the next state's own, so that all arcs to a state are one object.
    info[state] is (suffix, ranks of the tokens before its starts, -1 for none); equal states are one.  The starts are a
    suffix's own: where it, or a shorter one of its suffixes, begins a token.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.max_states = max_states
        self.longest = max(map(len, ranks), default=1)
        if self.longest > 255:
            raise ValueError("tokens of more than 255 bytes")
        #: Bytes that may wait before what is settled is emitted.
        self.lookahead = 2 * self.longest
        #: 1 for tokens, 2 for proper prefixes of tokens (what may stand between a token's start and the reading head), or both.
        self.kinds = dict.fromkeys((token[:i] for token in ranks for i in range(1, len(token))), 2)
        for token in ranks:
            self.kinds[token] = self.kinds.get(token, 0) | 1
        self.codes = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.token_of = {rank: token for token, rank in ranks.items()}
        #: left rank << 32 | rank: whether the one may follow the other.
        self.follows: dict[int, bool] = {}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.steps = 0
        self._reset()

    def _reset(self) -> None:
        #: (suffix, ranks): the arc to the state
        self.states: dict[tuple, int] = {}
        self.info: list[tuple] = []
        self.arcs: dict[int, int] = {}
        #: suffix: (itself, its starts)
        self.starts: dict[bytes, tuple[bytes, tuple[int, ...]]] = {b"": (b"", (0,))}
        self._to((b"", (-1,)), 0)

    def _to(self, key: tuple[bytes, tuple[int, ...]], size: int) -> int:
        """The arc to a state, with the length of the token that it ends with."""
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.info) << 8 | size
            self.info.append(key)
        return found

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that a token's last merge joins; a single byte, and a token that no merges give, has none."""
        found = self.split.get(token)
        if found is None:
            found = (b"", b"")
            if len(token) > 1:
                rank = self.ranks[token]
                parts = merge_encode(token, self.ranks, below=rank)
                found = (parts[0], parts[1]) if len(parts) == 2 else found
            self.split[token] = found
        return found

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether no merge ever crosses the border of a and b.

        Undo the merges beside the border, the last first.  The parts left and right of it, x and y, stand until the
        merge undone before; one of lower rank that joins them would have come first.  Of equal ranks the left merges
        first.
        """
        ranks, x, y, until, free = self.ranks, a, b, 1 << 60, True
        while free:
            if ranks.get(x + y, 1 << 60) < until:
                free = False
                break
            xs, ys = self._halves(x)[1], self._halves(y)[0]
            if not xs and not ys:
                break
            if xs and (not ys or ranks[x] > ranks[y]):
                until, x = ranks[x], xs
            else:
                until, y = ranks[y] + 1, ys
        return free

    def _arc(self, state: int, byte: int) -> int:
        """Make the arc of a byte, and the state that it leads to if that is new."""
        suffix, lefts = self.info[state]
        window = suffix + bytes((byte,))
        n, kinds, follows = len(window), self.kinds, self.follows
        last, kept, new_lefts = None, [], []
        for start, left in zip(self.starts[suffix][1], lefts):
            token = window[start:]
            kind = kinds.get(token, 0)
            if kind & 1 and last is None and (n - start == 1 or self._halves(token)[0]):
                rank = self.ranks[token]
                free = left < 0 or follows.get(left << 32 | rank)
                if free is None:
                    if len(follows) >= MAX_PAIRS:
                        follows.clear()
                    free = follows[left << 32 | rank] = self._may_follow(self.token_of[left], token)
                if free:
                    last, size = rank, n - start
            if kind & 2:
                kept.append(start)
                new_lefts.append(left)
        if last is None:
            raise ValueError("the ranks lack a single byte")
        kept.append(n)
        new_lefts.append(last)
        cut = kept[0]
        new = window[cut:]
        new = self.starts.setdefault(new, (new, tuple([x - cut for x in kept])))[0]
        key = (new, tuple(new_lefts))
        full = len(self.info) >= self.max_states and key not in self.states
        if full:
            self._reset()
            self.starts[new] = (new, tuple([x - cut for x in kept]))
        arc = self._to(key, size)
        if not full:
            self.arcs[state << 8 | byte] = arc
        return arc

    def stream(self, piece: Iterable[int]) -> Iterator[list[bytes]]:
        """The tokens of one piece as they are settled, the bytes coming one by one."""
        state, waiting, lasts = 0, bytearray(), []
        for byte in piece:
            arc = self.arcs.get(state << 8 | byte)
            if arc is None:
                arc = self._arc(state, byte)
            state = arc >> 8
            lasts.append(arc & 255)
            waiting.append(byte)
            self.steps += 1
            if len(lasts) >= self.lookahead and not len(lasts) % self.longest:
                # Later tokens start at one of the state's starts: where the paths to all of them meet is settled.
                suffix = self.info[state][0]
                ends = {len(lasts) - len(suffix) + s for s in self.starts[suffix][1]}
                while len(ends) > 1:
                    end = max(ends)
                    ends.remove(end)
                    ends.add(end - lasts[end - 1])
                (cut,) = ends
                if cut > 0:
                    yield self._path(waiting, lasts, cut)
                    del waiting[:cut], lasts[:cut]
        if lasts:
            yield self._path(waiting, lasts, len(lasts))

    @staticmethod
    def _path(waiting: bytearray, lasts: list[int], end: int) -> list[bytes]:
        """The tokens up to a boundary, back along the lengths."""
        out = []
        while end > 0:
            begin = end - lasts[end - 1]
            out.append(bytes(waiting[begin:end]))
            end = begin
        return out[::-1]

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers; a piece that is itself a token, which its merges
        might not give, is that token."""
        codes = self.codes
        if len(piece) >= self.lookahead:
            out = [codes[t] for some in self.stream(piece) for t in some]
        else:  # the same walk without a waiting line: the whole piece is within the lookahead
            state, arcs, out = 0, [], []
            get, add = self.arcs.get, arcs.append
            for byte in piece:
                arc = get(state << 8 | byte)
                if arc is None:
                    arc = self._arc(state, byte)
                    get = self.arcs.get
                state = arc >> 8
                add(arc)
            end = len(arcs)
            self.steps += end
            while end:
                begin = end - (arcs[end - 1] & 255)
                out.append(codes[piece[begin:end]])
                end = begin
            out.reverse()
        if len(out) > 1 and piece in codes:
            return codes[piece]
        return b"".join(out)


#: Fixed values, by Unicode: lead bytes of UTF-8 sequences (first, last), bytes that follow, range of the first of them.
UTF8_LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))


class Utf8Machine:
    """Bytes in, text out.  The state is (code point so far, bytes to come, range of the next one); an ill-formed sequence
    becomes U+FFFD, and the byte that breaks it is read anew."""

    REST = (0, 0, 0, 0)
    _LEAD = {b: ((b & (0x3F >> more)), more, low, high) for first, last, more, low, high in UTF8_LEADS for b in range(first, last + 1)}

    @classmethod
    def step(cls, state: tuple[int, int, int, int], byte: int) -> tuple[str, tuple[int, int, int, int]]:
        point, more, low, high = state
        broken = ""
        if more:
            if low <= byte <= high:
                point = point << 6 | byte & 0x3F
                return (chr(point), cls.REST) if more == 1 else ("", (point, more - 1, 0x80, 0xBF))
            broken = "�"
        if byte < 0x80:
            return broken + chr(byte), cls.REST
        begun = cls._LEAD.get(byte)
        return (broken, begun) if begun else (broken + "�", cls.REST)

    @classmethod
    def run(cls, state: tuple[int, int, int, int], data: bytes) -> tuple[str, tuple[int, int, int, int]]:
        out = []
        for byte in data:
            text, state = cls.step(state, byte)
            out.append(text)
        return "".join(out), state


class BpeCodec:
    """Texts to ids and back, for one vocabulary and one pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES):
        import regex

        self.find = regex.compile(pattern).findall
        self.fst = BpeTransducer(ranks)
        self.pieces = Memo(max_pieces)
        self.table = UnitTable(self._units, lambda text: self._units([text])[0], cuts=pattern == SPACE_PATTERN)
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of, self.text_of = [b""] * size, [""] * size
        #: Whether a token leads the machine from its state of rest to rest; then text_of is what it gives.
        self.closed = np.zeros(size, bool)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.text_of[rank], state = Utf8Machine.run(Utf8Machine.REST, token)
            self.closed[rank] = state == Utf8Machine.REST

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units by those of their pieces; a unit that is a known piece needs no cutting."""
        out = list(map(self.pieces.new.get, units)) if self.table.cuts else [None] * len(units)
        left = [i for i, x in enumerate(out) if x is None]
        cut = [self.find(units[i]) for i in left]
        encode = self.fst.encode_piece
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.pieces.found(distinct, lambda some: [encode(p.encode("utf-8")) for p in some])))
        for i, c in zip(left, cut):
            out[i] = ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c))
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        return self.table.encode(texts)

    def decode_stream(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text of id chunks as they come; a code point cut by a chunk's end waits for the rest."""
        rest = state = Utf8Machine.REST
        for chunk in chunks:
            ids = np.frombuffer(chunk, "<u4")
            open_at = np.flatnonzero(~self.closed[ids]).tolist()
            out, at, ids = [], 0, ids.tolist()
            if state != rest and ids:
                open_at = [0, *open_at]
            for i in open_at:
                if i < at:
                    continue
                out += map(self.text_of.__getitem__, ids[at:i])
                at = i
                while at < len(ids) and (at == i or state != rest):
                    text, state = Utf8Machine.run(state, self.bytes_of[ids[at]])
                    out.append(text)
                    at += 1
            out += map(self.text_of.__getitem__, ids[at:])
            if out:
                yield "".join(out)
        if state != rest:
            yield "�"


_CODECS = Kept()


def codec(path: str, pattern: str) -> BpeCodec:
    """One codec in a worker for each vocabulary, as long as tasks use it."""
    gc.set_threshold(100_000, 50, 1000)  # the tables hold many live objects and no cycles
    return _CODECS.get((path, pattern), lambda: BpeCodec(load_ranks(path), pattern))


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, output: str = "texts", stream_ids: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens and, by `output`,

    texts: ids (array of token ids) and decoded (the text that the streaming decoder makes of them);
    ids: ids and exact (whether the decoded text is the text);
    digests: ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the decoded bytes).

    A null or empty text has no tokens.  Rows are independent: repeated rows give repeated results, an empty table an
    empty result, other columns are not kept.
    """
    kinds = {"texts": ("ids array<int>", "decoded string"), "ids": ("ids array<int>", "exact boolean"), "digests": ("ids_sha256 string", "decoded_sha256 string")}[output]
    a, b = (k.split()[0] for k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * stream_ids
        for batch in batches:
            for part in portions(batch, most_bytes=PORTION):
                c = codec(ranks_path, pattern)
                ids_of = c.encode(part.column(1))
                n = [len(ids) // 4 for ids in ids_of]
                first, second = [], []
                for i, ids in enumerate(ids_of):
                    parts = c.decode_stream(ids[k : k + step] for k in range(0, len(ids), step))
                    if output == "digests":
                        first.append(hashlib.sha256(ids).hexdigest())
                        decoded = hashlib.sha256()
                        for x in parts:
                            decoded.update(x.encode("utf-8"))
                        second.append(decoded.hexdigest())
                    else:
                        decoded_text = "".join(parts)
                        second.append(decoded_text == part.column(1)[i].as_py() if output == "ids" else decoded_text)
                if output == "digests":
                    made = pa.array(first, pa.string())
                else:
                    ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids_of), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), made, pa.array(second, pa.bool_() if output == "ids" else pa.string())], ["doc_id", "n_tokens", a, b])
                del part, ids_of, first, second, made
            del batch  # else it stands beside the next one

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(("doc_id long", "n_tokens long", *kinds)))
