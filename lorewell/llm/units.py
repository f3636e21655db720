"""Texts cut into units that byte-level tokenizers encode independently.

The patterns of these tokenizers start a new piece at every single space between two characters that aren't white
space.  So a text whose spaces all stand like that can be cut before each space, and equal units, which are many, need
looking up once for a whole batch of texts.  Other texts stay whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the widest sense.
_WHITE = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A space at either end or beside white space, and an empty text: those stay whole.
_IRREGULAR = rf"\A |\A\z| \z| [{_WHITE}]|[{_WHITE}] "

UNITS_AT_ONCE = 10_000

#: Fixed value: the piece pattern for which cutting before single spaces is known to change nothing.
SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Memo:
    """A bounded table: at `most` entries the younger half becomes the older, and that is dropped."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}

    def found(self, keys: list, make: Callable[[list], list]) -> list:
        """Values of distinct keys; those in neither half are made together."""
        self.turn()
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        missing = []
        for i, v in enumerate(out):
            if v is None:
                v = old.get(keys[i])
                if v is None:
                    missing.append(i)
                else:
                    out[i] = new[keys[i]] = v
        if missing:
            for i, v in zip(missing, make([keys[i] for i in missing])):
                out[i] = new[keys[i]] = v
        return out


def portions(batch: pa.RecordBatch, column: int = 1, most_bytes: int = 3 << 20, most_rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded text (one longer text alone): few texts at a time become arrays."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        upto = min(max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right"))), at + most_rows)
        yield batch.slice(at, upto - at)
        at = upto


class UnitTable:
    """Ids of texts, each distinct unit of a batch made once.

    make(units): ids of units, as little-endian unsigned 32-bit integers; each unit begins with its space, but for a
    text's first one.  whole(text): ids of a text that can't be cut.  whole_if: texts that hold one of these stay whole.
    mark: the space; irregular: a pattern of texts that can't be cut before each mark.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], whole_if: tuple[str, ...] = (), cuts: bool = True, mark: str = " ", irregular: str = _IRREGULAR):
        self.make, self.whole, self.whole_if, self.cuts, self.mark, self.irregular = make, whole, whole_if, cuts, mark, irregular

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (none is null)."""
        out: list[bytes] = [b""] * len(texts)
        irregular = pc.match_substring_regex(texts, self.irregular) if self.cuts else pa.array(np.ones(len(texts), bool))
        for s in self.whole_if:
            irregular = pc.or_(irregular, pc.match_substring(texts, s))
        irregular = irregular.to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(irregular).tolist():
            text = texts[i].as_py()
            out[i] = self.whole(text) if text else b""
        regular = np.flatnonzero(~irregular)
        if not len(regular):
            return out
        lists = pc.split_pattern(texts.take(pa.array(regular)) if len(regular) < len(texts) else texts, self.mark)
        begins = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        where, values = coded.indices.to_numpy(), coded.dictionary
        inner = np.ones(len(where), bool)
        inner[begins] = False
        used = np.flatnonzero(np.bincount(where[inner], minlength=len(values)))
        firsts, place = np.unique(where[begins], return_inverse=True)
        slot = np.zeros(len(values), np.int64)
        slot[used] = np.arange(len(used))
        at = slot[where]
        at[begins] = len(used) + place
        found = []
        for kind, lead in ((used, self.mark), (firsts, "")):
            for low in range(0, len(kind), UNITS_AT_ONCE):  # few units at a time become Python objects
                found += self.make([lead + u for u in values.take(pa.array(kind[low : low + UNITS_AT_ONCE])).to_pylist()])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()
        stops = 4 * ends[np.append(begins[1:], len(where)) - 1]
        a = 0
        for i, b in zip(regular.tolist(), stops.tolist()):
            out[i] = ids[a:b]
            a = b
        return out
