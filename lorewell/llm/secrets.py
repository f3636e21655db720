"""Secret scans through a trigram inverted index.

Each rule's regex is parsed and turned into a Boolean query of trigrams that every match must contain.  Texts are
indexed a segment at a time: the postings of the trigrams that any rule asks for.  A rule's query intersects and unites
postings; only the texts that remain are verified with the regex.  A rule without mandatory trigrams scans every text.
The index folds A-Z to a-z, so it never rules out what a case-blind rule would match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # Python before 3.11
    import sre_constants as sre
    import sre_parse

#: Most strings that an exact part of a regex may stand for before it is turned into trigrams.
MOST_STRINGS = 64
SEGMENT_BYTES = 4 << 20

#: A query: True (anything), a trigram, or ("and" | "or", queries).
Query = bool | bytes | tuple


def all_of(*queries: Query) -> Query:
    parts = frozenset(q for q in queries if q is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def any_of(*queries: Query) -> Query:
    parts = frozenset(queries)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings: frozenset[str]) -> Query:
    def one(s: str) -> Query:
        raw = s.lower().encode("utf-8")
        return all_of(*(raw[i : i + 3] for i in range(len(raw) - 2)))

    return any_of(*(one(s) for s in strings))


def _strings(op, arg) -> frozenset[str] | None:
    """All strings that a part of a regex can match, if they are few."""
    if op is sre.LITERAL:
        return frozenset((chr(arg).lower(),)) if arg < 128 else None
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < 4:
                out.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact(arg[-1])
    if op is sre.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return frozenset().union(*parts) if all(x is not None for x in parts) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = _exact(arg[2])
        return None if inner is None else inner | {""} if arg[0] == 0 else inner
    if op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
        inner = _exact(arg[2])
        return None if inner is None or len(inner) > 1 else frozenset(x * arg[0] for x in inner)
    if op is sre.AT:
        return frozenset(("",))
    return None


def _exact(nodes) -> frozenset[str] | None:
    out = frozenset(("",))
    for op, arg in nodes:
        own = _strings(op, arg)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a, b in product(out, own))
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean query of trigrams that holds for every text with a match."""

    def of(nodes) -> Query:
        parts, run = [], frozenset(("",))
        for op, arg in nodes:
            own = _strings(op, arg)
            if own is not None and len(run) * len(own) <= MOST_STRINGS:
                run = frozenset(a + b for a, b in product(run, own))
                continue
            parts.append(_of_strings(run))
            run = frozenset(("",)) if own is None else own
            if own is None:
                if op is sre.SUBPATTERN:
                    parts.append(of(arg[-1]))
                elif op is sre.BRANCH:
                    parts.append(any_of(*(of(x) for x in arg[1])))
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0] > 0:
                    parts.append(of(arg[2]))
        return all_of(*parts, _of_strings(run))

    return of(sre_parse.parse(pattern))


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1])) if isinstance(query, tuple) else set()


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose group is shorter than least are dropped; any_case holds for ASCII letters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | re.IGNORECASE if self.any_case else re.ASCII)

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: Fixed patterns, in the order in which their kinds are listed.  The bound of hex is in its quantifier: a run of hex
#: digits is matched whole or not at all either way.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Further public token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class TrigramIndex:
    """Postings of the asked trigrams over the texts of one segment."""

    def __init__(self, texts: list[bytes], asked: set[bytes]):
        self.n = len(texts)
        self.postings: dict[bytes, np.ndarray] = {}
        if not asked:
            return
        raw = _FOLD[np.frombuffer(b"\0\0".join(texts) + b"\0\0", dtype=np.uint8)]
        begins = np.cumsum([0] + [len(t) + 2 for t in texts])
        wanted = np.zeros(256, dtype=bool)
        wanted[[t[0] for t in asked]] = True
        at = np.flatnonzero(wanted[raw[:-2]])
        codes = (raw[at].astype(np.int32) << 16) | (raw[at + 1].astype(np.int32) << 8) | raw[at + 2]
        of = {int.from_bytes(t, "big"): t for t in asked}
        known = np.array(sorted(of), dtype=np.int32)
        slot = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[slot] == codes
        slot, at = slot[hit], at[hit]
        pairs = np.unique(slot.astype(np.int64) * self.n + (np.searchsorted(begins, at, side="right") - 1))
        slots, docs = pairs // self.n, pairs % self.n
        for i, code in enumerate(known.tolist()):
            a, b = np.searchsorted(slots, (i, i + 1))
            self.postings[of[code]] = docs[a:b]

    def search(self, query: Query) -> np.ndarray:
        """Texts for which a query holds, ascending."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        found = sorted((self.search(q) for q in query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def scan(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of each text's secrets, by start, then by the rules' order."""
    asked = set().union(*(trigrams_of(r.query) for r in rules)) if rules else set()
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        raw, size = [], 0
        while at + len(raw) < len(texts) and (not raw or size < SEGMENT_BYTES):
            raw.append(texts[at + len(raw)].encode("utf-8"))
            size += len(raw[-1])
        index = TrigramIndex(raw, asked)
        for order, rule in enumerate(rules):
            for i in index.search(rule.query).tolist():
                out[at + i] += [(a, order, b) for a, b in rule.spans(texts[at + i])]
        at += len(raw)
    return [[(rules[k].kind, a, b) for a, k, b in sorted(spans)] for spans in out]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end) in code points, the end exclusive.

    Spans of one kind don't overlap, those of different kinds may.  A null or empty text has none.  Rows are independent:
    repeated rows give repeated results, an empty table an empty result, other columns are not kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = scan(pdf["text"].tolist(), rules)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]})

    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans) -> "F.Column":
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    found = find_secrets(docs)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """A text with its secrets replaced; overlapping spans become one, named after the first."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], mark.format(kind)]
        done = max(done, b)
    return "".join([*out, text[done:]])


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, secrets in the texts replaced by their kinds; chars_col, if there, is the new length."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(text_col).to_pylist()
                found = scan([t or "" for t in texts], rules)
                if any(found):
                    clean = [redacted(t, s) if s else t for t, s in zip(texts, found)]
                    part = part.set_column(names.index(text_col), part.schema.field(text_col), pa.array(clean, part.schema.field(text_col).type))
                    if chars_col in names:
                        old = part.column(chars_col).to_pylist()
                        new = [len(t) if s else n for t, s, n in zip(clean, found, old)]
                        part = part.set_column(names.index(chars_col), part.schema.field(chars_col), pa.array(new, part.schema.field(chars_col).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
