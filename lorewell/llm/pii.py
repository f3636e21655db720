"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions alone.  Java's split and extract functions give the texts between and in a pattern's matches; their
lengths give the positions.  The patterns below say what the documented ones say, written so that the regex engine needs
neither recursion nor a second try at a place: runs are possessive, and a match can only begin where a run begins or
the match before ended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .winnow import let


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether a number's digits pass Luhn's check: from the right every second one doubled, digits summed, by ten."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
            return acc + F.when(i % 2 == 1, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)

    return let(digits(match), total) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether an IBAN is 1 modulo 97: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, acc * 100 + letter).otherwise(acc * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(moved, "(?!^)(?=.)"), F.lit(0), add) == 1


def ip_parts(match: Column) -> Column:
    """Whether all four parts are at most 255."""
    return F.forall(F.split(match, "\\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def between(low: int, high: int):
    """A check of the number of digits."""
    return lambda match: F.length(digits(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """What a kind's matches look like, what confirms them, and how words nearby count.

    hint: a character that every match has.  score: of a confirmed match; near: added if one of the context words
    stands within `reach` code points.  Matches below `least` are dropped.
    """

    name: str
    pattern: str
    check: object = None
    hint: str = ""
    context: str = ""
    score: float = 0.6
    near: float = 0.3
    least: float = 0.0


#: Kinds whose confirmed matches are always kept, in the order in which they are listed.
BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", hint="@", context="mail|contact|write", score=0.7),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ip_parts, hint=".", context="address|host|server|ip"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", luhn, context="card|visa|master|amex|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", between(9, 15), hint="+", context="phone|call|tel|mobile|fax"),
)
#: Kinds that the method adds: confirmed by a checksum, or by words nearby.
MORE_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, context="iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", context="ssn|social security|social-security", score=0.2, near=0.6, least=0.5),
)
REACH = 40
#: Matches are placed so many at a time; as many neighbours as can stand within REACH (none is shorter than 3) go with them.
AT_ONCE = 256
AROUND = -(-REACH // 3) + 1


def _running(lengths: Column, begin: Column) -> Column:
    """Sums of an array's items before each of them, from `begin` on."""
    zero = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind in a text, in code points, the end exclusive.

    A text is cut into gaps and matches once.  Lengths give positions, by sums over blocks of matches and within each, so
    that time grows with the text, not with its square; context words are looked for in a block's own text, where a long
    gap keeps only its ends."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def block(found: Column, gaps: Column, c: Column, start: Column) -> Column:
        """Spans of the matches from c * AT_ONCE on."""
        first = F.greatest(c * AT_ONCE - AROUND, F.lit(0))
        skip = c * AT_ONCE - first
        near = F.slice(found, first + 1, skip + AT_ONCE + AROUND)
        beside = F.transform(F.slice(gaps, first + 1, F.size(near) + 1), lambda g: F.when(F.length(g) > 2 * REACH, F.concat(F.left(g, F.lit(REACH)), F.lit(" "), F.right(g, F.lit(REACH)))).otherwise(g))
        pairs = F.zip_with(beside, near, lambda g, m: F.struct(F.length(g).alias("gap"), F.concat(g, F.coalesce(m, F.lit(""))).alias("both")))
        own = F.slice(found, c * AT_ONCE + 1, AT_ONCE)
        before = F.slice(gaps, c * AT_ONCE + 1, F.size(own))
        starts = F.zip_with(_running(F.zip_with(before, own, lambda g, m: F.length(g) + F.length(m)), start), before, lambda at, g: at + F.length(g))

        def placed(pairs: Column) -> Column:
            inside = F.zip_with(_running(F.transform(pairs, lambda p: F.length(p["both"])), F.lit(0)), pairs, lambda at, p: at + p["gap"])
            spots = F.arrays_zip(own.alias("match"), starts.alias("start"), F.slice(inside, skip + 1, F.size(own)).alias("at"))
            if kind.check is not None:
                spots = F.filter(spots, lambda s: kind.check(s["match"]))
            out = let(F.array_join(F.transform(pairs, lambda p: p["both"]), ""), lambda local: F.transform(spots, lambda s: scored(local, s)))
            return F.filter(out, lambda s: s["score"] >= kind.least) if kind.least else out

        def scored(local: Column, s: Column) -> Column:
            begin = F.greatest(s["at"] - REACH, F.lit(0))
            around = F.lower(F.substring(local, begin + 1, s["at"] - begin + F.length(s["match"]) + REACH))
            score = F.lit(kind.score) + F.when(F.rlike(around, F.lit(f"\\b(?:{kind.context})")), F.lit(kind.near)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["match"])).alias("end"), score.alias("score"))

        return let(pairs, placed)

    def placed(found: Column) -> Column:
        def blocks(gaps: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / AT_ONCE).cast("int"))

            def length(c: Column) -> Column:
                own = F.slice(found, c * AT_ONCE + 1, AT_ONCE)
                return F.aggregate(F.zip_with(F.slice(gaps, c * AT_ONCE + 1, F.size(own)), own, lambda g, m: F.length(g) + F.length(m)), F.lit(0), lambda a, n: a + n)

            starts = _running(F.transform(numbers, length), F.lit(0))
            return F.flatten(F.zip_with(numbers, starts, lambda c, start: block(found, gaps, c, start)))

        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), blocks)).otherwise(none)

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.hint:
        found = F.when(F.instr(text, kind.hint) > 0, found).otherwise(F.array().cast("array<string>"))
    return let(found, placed)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = BASE_KINDS + MORE_KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and, for each kind, a column of its spans (kind, start, end, score).

    Spans of one kind don't overlap, those of different kinds may.  A null or empty text has none.  Rows are
    independent: repeated rows give repeated results, an empty table an empty result, other columns are not kept.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", *(spans_of(F.col("text"), k).alias(k.name) for k in kinds))


def joined(spans: list[Column]) -> Column:
    """kind:start:end of spans, comma-joined."""
    every = F.flatten(F.array(*spans))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each document."""
    found = find_pii(docs)
    base, every = [F.col(k.name) for k in BASE_KINDS], [F.col(k.name) for k in BASE_KINDS + MORE_KINDS]
    return found.select("doc_id", *(F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "*") -> Column:
    """A text with every code point of some non-overlapping spans (ascending) replaced."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, F.repeat(F.lit(mark), s["end"] - s["start"])).alias("out"))

    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return let(end, lambda e: F.concat(e["out"], F.substring(text, e["at"] + 1, F.length(text))))
