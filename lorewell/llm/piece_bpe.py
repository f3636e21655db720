"""SentencePiece encoding of merge type, exact, by backtracking over longest matches.

A sequence of pieces is what merging makes of a text exactly if every two neighbours, merged again by themselves, stay
the same two pieces; so there is one such sequence.  It is searched from the left: an Aho-Corasick automaton finds the
longest piece at each position; a piece is taken if it is compatible with the one before it and its end isn't known to
have failed; else the next shorter piece that begins like it is tried; when none is left, the position goes into a
bitfield of failed positions and the search steps back.  Each position fails at most once, so a text takes linear time.

Compatibility is checked by re-merging: the merges that make each of the two pieces are replayed side by side, in the
order in which they would happen, and the pair is refused if at some moment a merge over the border comes first.

Texts are cut where no piece of the vocabulary reaches over (seen when it is loaded): before a space mark that follows
another character, between letters and other characters, and around characters that no piece holds.
"""

from __future__ import annotations

import array
import codecs
import gc
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, id_and_text
from .units import Memo, UnitTable, portions

#: Fixed value: the mark that stands for a space.
SPACE = "▁"
#: Fixed value: what the unknown piece decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Bounds of what a worker keeps; reaching one empties that table and changes no result.
MAX_PARTS = 250_000
MAX_PAIRS = 300_000
_NEVER = float("inf")

codecs.register_error("lorewell-byte", lambda e: ("�", e.start + 1))  # one replacement for each byte that fits nowhere


def merge_pieces(text: str, ranks: dict[str, float]) -> list[str]:
    """The definition: merge the leftmost pair of best rank until no two neighbours make a piece."""
    parts = list(text)
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == _NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BacktrackingEncoder:
    """Strings over the pieces' characters to sequences of pieces (numbers; `strings` has what they stand for).

    Characters that only longer pieces hold count as pieces too, without a rank: merging begins with them.
    """

    def __init__(self, ranks: dict[str, float]):
        import ahocorasick

        self.ranks = ranks
        self.strings = list(ranks) + sorted(set("".join(ranks)) - set(ranks))
        self.number = {s: i for i, s in enumerate(self.strings)}
        self.lengths = list(map(len, self.strings))
        self.shorter = [next((self.number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.number), -1) for s in self.strings]
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(self.strings):
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.histories: dict[int, tuple[list[float], list[str], list[str]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def history(self, piece: int) -> tuple[list[float], list[str], list[str]]:
        """How merging goes inside a piece: the rank of each merge, the first and the last part before each and at the end.

        A piece that merging doesn't make of its own characters ends in several parts; no border is then compatible.
        """
        found = self.histories.get(piece)
        if found is None:
            parts, ranks, firsts, lasts = list(self.strings[piece]), [], [], []
            while True:
                firsts.append(parts[0])
                lasts.append(parts[-1])
                rank, at = min(((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(_NEVER, 0))
                ranks.append(rank)
                if rank == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.histories[piece] = (ranks, firsts, lasts)
        return found

    def made(self, piece: int) -> bool:
        """Whether merging a piece's characters gives the piece."""
        return self.history(piece)[1][-1] == self.strings[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces' characters, merged together, end as these two pieces."""
        (a, _, lasts), (b, firsts, _) = self.history(left), self.history(right)
        if not (self.made(left) and self.made(right)):
            return False
        get, i, j = self.ranks.get, 0, 0
        while True:
            across = get(lasts[i] + firsts[j], _NEVER)
            # Of equal ranks the leftmost merge goes first: one inside the left piece, then the border, then the right piece.
            if across < a[i] and across <= b[j] and across != _NEVER:
                return False
            if a[i] == b[j] == _NEVER:
                return True
            if a[i] <= b[j]:
                i += 1
            else:
                j += 1

    def encode(self, text: str) -> list[int]:
        """Pieces of a text whose every character is in some piece."""
        number = self.number.get(text)
        if number is not None and self.made(number):
            return [number]
        n, lengths, shorter, pairs = len(text), self.lengths, self.shorter, self.pairs
        longest = [-1] * n
        most = [0] * n
        for end, piece in self.automaton.iter(text):
            size = lengths[piece]
            if size > most[end + 1 - size]:
                most[end + 1 - size], longest[end + 1 - size] = size, piece
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, piece, last = 0, longest[0], -1
        while at < n:
            end = at + lengths[piece]
            good = not failed[end >> 3] >> (end & 7) & 1
            if good and last >= 0:
                good = pairs.get((last, piece))
                if good is None:
                    if len(pairs) >= MAX_PAIRS:
                        pairs.clear()
                    good = pairs[last, piece] = self.compatible(last, piece)
            elif good:
                good = self.made(piece)
            if good:
                out.append(piece)
                at, last = end, piece
                if at < n:
                    piece = longest[at]
                continue
            piece = shorter[piece]
            while piece < 0:  # nothing that begins here is left
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= lengths[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]
        return out


class PieceCodec:
    """Texts to ids and back, for one model of merge type with byte fallback and without user-defined or unused pieces."""

    def __init__(self, path: str, max_parts: int = MAX_PARTS):
        import sentencepiece

        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.byte_ids = [i for i in range(size) if model.is_byte(i)]
        if len(self.byte_ids) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        self.byte_ids.sort(key=lambda i: int(pieces[i][3:5], 16))
        self.encoder = BacktrackingEncoder({p: -model.get_score(i) for i, p in enumerate(pieces) if not special[i]})
        #: Ids of the encoder's pieces as little-endian unsigned 32-bit integers; a character without an id gives its bytes.
        ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.ids_of = [self._packed([ids[s]] if s in ids else self._fallback(s)) for s in self.encoder.strings]
        known = set("".join(ids))
        chars = {kind: "".join(re.escape(x) for x in sorted(known - {SPACE}) if x.isalpha() == kind) for kind in (True, False)}
        self.reaches = any(SPACE in p.lstrip(SPACE) for p in ids)  # a piece that spans the usual cuts
        mixes = self.reaches or any(len({x.isalpha() for x in p.lstrip(SPACE)}) > 1 for p in ids)
        runs = [f"{SPACE}*[{c}]+" for c in chars.values() if c] if not mixes else []
        inside = "".join(map(re.escape, sorted(known)))
        self.cut = re.compile("|".join([*runs, f"[{inside}]+", f"[^{inside}]+"])).findall
        self.known = known
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.parts = Memo(max_parts)
        self.table = UnitTable(self._units, self._whole, cuts=not self.reaches, mark=SPACE, irregular=SPACE * 2)
        #: What an id decodes to, in bytes; the decimal digits of each id.
        self.bytes_of = [bytes([int(pieces[i][3:5], 16)]) if model.is_byte(i) else UNKNOWN_TEXT.encode() if model.is_unknown(i) else b"" if model.is_control(i) else pieces[i].replace(SPACE, " ").encode("utf-8") for i in range(size)]
        self.strips = [not s and p.startswith(SPACE) for s, p in zip(special, pieces)]
        self.silent = np.array([model.is_control(i) for i in range(size)], bool)
        self.digits = np.array([str(i) for i in range(size)], dtype=object)
        self.dummy = model.normalize("a") == SPACE + "a"

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array.array("I", ids).tobytes()

    def _fallback(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode("utf-8")]

    def _part(self, part: str) -> bytes:
        if part[0] not in self.known:
            return self._packed(self._fallback(part))
        return b"".join([self.ids_of[p] for p in self.encoder.encode(part)])

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of units by those of their parts; a unit that is a known part needs no cutting."""
        out = list(map(self.parts.new.get, units))
        left = [i for i, x in enumerate(out) if x is None]
        cut = [self.cut(units[i]) for i in left]
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        ids = dict(zip(distinct, self.parts.found(distinct, lambda some: list(map(self._part, some)))))
        for i, c in zip(left, cut):
            out[i] = ids[c[0]] if len(c) == 1 else b"".join(map(ids.__getitem__, c))
        return out

    def _whole(self, text: str) -> bytes:
        return b"".join(self._units([text] if self.reaches else self.runs(text)))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; the library normalises them first."""
        return self.table.encode(pa.array(self.model.normalize(texts.to_pylist()), pa.string()))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: marks become spaces, the dummy prefix goes, runs of byte pieces become characters."""
        runs = [ids] if not self.silent[ids].any() else np.split(ids, np.flatnonzero(self.silent[ids]))  # control pieces end a run
        out = [b"".join(map(self.bytes_of.__getitem__, run.tolist())).decode("utf-8", "lorewell-byte") for run in runs]
        first = ids[~self.silent[ids]][:1]
        text = "".join(out)
        return text[1:] if self.dummy and len(first) and self.strips[first[0]] else text


_CODECS = Kept()


def codec(path: str) -> PieceCodec:
    """One codec in a worker for each model, as long as tasks use it."""
    gc.set_threshold(100_000, 50, 1000)  # the tables hold many live objects and no cycles
    return _CODECS.get(path, lambda: PieceCodec(path))


def piece_encode(docs: DataFrame, model_path: str, output: str = "texts", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, n_tokens and, by `output`,

    texts: ids (array of piece ids, without begin and end) and decoded (the text that they decode to);
    digests: ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of the decoded text in UTF-8).

    A null or empty text has no ids and decodes to nothing.  Rows are independent: repeated rows give repeated results,
    an empty table an empty result, other columns are not kept.
    """
    kinds = {"texts": ("ids array<int>", "decoded string"), "digests": ("ids_sha256 string", "decoded_sha256 string")}[output]
    a, b = (k.split()[0] for k in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch):
                c = codec(model_path)
                coded = c.encode(part.column(1))
                arrays = [np.frombuffer(x, "<u4") for x in coded]
                n = pa.array([len(x) for x in arrays], pa.int64())
                if output == "digests":
                    first = pa.array([hashlib.sha256(",".join(c.digits[x].tolist()).encode()).hexdigest() for x in arrays], pa.string())
                    second = pa.array([hashlib.sha256(c.decode(x).encode("utf-8")).hexdigest() for x in arrays], pa.string())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
                    first = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                    second = pa.array(list(map(c.decode, arrays)), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), n, first, second], ["doc_id", "n_tokens", a, b])

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(("doc_id long", "n_tokens long", *kinds)))
