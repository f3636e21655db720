"""Chunkers: windows over plain text, sections of Markdown, symbols of code; neighbours know their overlap.

`chunk` gives spans; `corpus_chunks` gives them as a corpus keeps them, with where they come from.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "document_id string, kind string, title string, char_start int, char_end int, text string"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
_SYMBOL = re.compile(r"^(?:async\s+)?(?:def|class|func|function|fn|interface|struct)\s+([A-Za-z_]\w*)", re.M)
#: How far before a window's end a line or sentence end is looked for.
REACH = 240


#: Texts whose chunks a worker holds at once.
TEXTS_AT_ONCE = 100


def few(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of at most TEXTS_AT_ONCE rows: the chunks of a batch are held together, and they are larger than its texts."""
    for pdf in batches:
        for at in range(0, len(pdf), TEXTS_AT_ONCE):
            yield pdf.iloc[at : at + TEXTS_AT_ONCE]


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most `size` characters, each ended at a paragraph, line or sentence end if one is near; the next
    starts size - overlap further on."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    for start in range(0, len(text), size - overlap):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", ". "):
                at = text.rfind(mark, max(start + 1, end - REACH), end)
                if at > start:
                    end = at + len(mark)
                    break
        yield start, end
        if start + size >= len(text):
            return


def sections(text: str, pattern: re.Pattern) -> list[tuple[str, int, int]]:
    """(title, start, end) from one match to the next; what stands before the first has no title."""
    marks = [(m.group(m.lastindex), m.start()) for m in pattern.finditer(text)]
    if not marks or marks[0][1] > 0:
        marks.insert(0, ("", 0))
    ends = [s for _, s in marks[1:]] + [len(text)]
    return [(t, s, e) for (t, s), e in zip(marks, ends) if text[s:e].strip()]


def chunk(docs: DataFrame, size: int = 1024, overlap: int = 100) -> DataFrame:
    """Chunks of (document_id, kind, text): SCHEMA and the overlap with the chunks before and after.

    kind md is cut at headings, py, js, go and rs at symbols, all else into windows; a section longer than `size` is cut
    into windows too.  A null or empty text has no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = []
            for doc, kind, text in zip(pdf["document_id"], pdf["kind"], pdf["text"]):
                pattern = _HEADING if kind == "md" else _SYMBOL if kind in ("py", "js", "go", "rs") else None
                for title, a, b in sections(text, pattern) if pattern else [("", 0, len(text))]:
                    out += [(doc, kind, title, a + s, a + e, text[a + s : a + e]) for s, e in windows(text[a:b], size, overlap)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col("document_id").cast("string"), F.coalesce("kind", F.lit("txt")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    per = Window.partitionBy("document_id").orderBy("char_start", "char_end")
    found = rows.mapInPandas(run, SCHEMA).withColumn("chunk_index", F.row_number().over(per) - 1)
    before = F.greatest(F.lit(0), F.coalesce(F.lag("char_end").over(per) - F.col("char_start"), F.lit(0)))
    after = F.greatest(F.lit(0), F.coalesce(F.col("char_end") - F.lead("char_start").over(per), F.lit(0)))
    return found.withColumn("overlap_before", before).withColumn("overlap_after", after)


#: File endings of each kind, and the sizes from which a text is a large file and a section stands alone.
MARKDOWN_ENDS = ("md", "markdown", "mdx", "rst")
CODE_ENDS = ("py", "js", "ts", "tsx", "jsx", "java", "go", "rs", "cpp", "c", "h", "hpp", "cs", "php", "rb", "swift", "kt", "kts")
#: Fixed value: what begins a symbol of code, indented or not.
DECLARED = re.compile(r"^\s*(?:def|class|function|interface|enum|struct|impl|func)\s+([A-Za-z_][A-Za-z0-9_]*)", re.M)
LARGE_FACTOR, LARGE_LEAST, LARGE_WINDOW = 8, 20_000, 1200
MERGE_LEAST, MERGE_SHARE = 120, 0.30
CORPUS = "document_id string, chunk_id string, chunk_index int, source_type string, strategy string, title string, level int, path string, char_start int, char_end int, line_start int, line_end int, window_index int, window_total int, text string"


def spans(length: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of a length; the last one ends with it."""
    step = max(1, size - overlap)
    return [(a, min(length, a + size)) for a in range(0, max(length - size, 0) + step, step)] if length else []


def aligned(text: str, start: int, end: int) -> int:
    """The end of the last paragraph, else line, that a window holds near its end; its own end if there is none."""
    if end >= len(text):
        return len(text)
    low = max(start + 1, end - REACH)
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, low, end)
        if at >= low:
            return at + len(mark)
    return end


def _outline(text: str) -> list[dict]:
    """Sections of Markdown with their level and the titles above them; a short text before the first heading joins it."""
    marks = [(m.start(), len(m.group(1)), m.group(2).strip()) for m in _HEADING.finditer(text)]
    if not marks:
        return [{"title": "document", "level": 0, "path": "document", "start": 0, "end": len(text)}]
    if marks[0][0] > 0:
        marks.insert(0, (0, 0, "preamble"))
    above: list[tuple[int, str]] = []
    out = []
    for (start, level, title), end in zip(marks, [m[0] for m in marks[1:]] + [len(text)]):
        above = [a for a in above if a[0] < level] + [(level, title)]
        out.append({"title": title, "level": level, "path": " > ".join(t for _, t in above), "start": start, "end": end})
    return out


def _pieces(text: str, kind: str, size: int, overlap: int) -> list[dict]:
    """Chunks of one text, without what depends on their neighbours."""
    out = []
    if kind == "markdown":
        parts = _outline(text)
        if len(parts) > 1 and parts[0]["level"] == 0 and parts[0]["end"] < max(MERGE_LEAST, int(size * MERGE_SHARE)):
            # What is merged keeps the name of the first; one that is still short goes on to the next.
            parts[:2] = [parts[0] | {"end": parts[1]["end"]}]
            while len(parts) > 1 and parts[0]["end"] < max(MERGE_LEAST, int(size * MERGE_SHARE)):
                parts[:2] = [parts[0] | {"end": parts[1]["end"]}]
        for part in parts:
            for a, b in spans(part["end"] - part["start"], size, overlap):
                a, b = part["start"] + a, part["start"] + b
                out.append((a, min(part["end"], aligned(text[: part["end"]], a, b)), "markdown_section", part, None, None))
    elif kind == "code":
        marks = [(m.start(), m.group(1)) for m in DECLARED.finditer(text)] or [(0, "module")]
        if marks[0][0] > 0:
            marks.insert(0, (0, "module_preamble"))
        for (start, name), end in zip(marks, [m[0] for m in marks[1:]] + [len(text)]):
            for a, b in spans(end - start, size, overlap) if end - start > size else [(0, end - start)]:
                out.append((start + a, start + b, "code_symbol", {"title": name, "level": None, "path": name}, None, None))
    else:
        large = kind == "large_file"
        found = spans(len(text), max(size, LARGE_WINDOW) if large else size, overlap)
        for i, (a, b) in enumerate(found):
            b = b if large else aligned(text, a, b)
            out.append((a, b, "large_file_excerpt" if large else "generic_window", {"title": None, "level": None, "path": None}, i if large else None, len(found) if large else None))
    kept = []
    for a, b, strategy, part, i, n in out:
        own = text[a:b].strip("\n") if strategy == "code_symbol" else text[a:b].strip()
        if own.strip():
            kept.append({"strategy": strategy, "title": part["title"], "level": part["level"], "path": part["path"], "char_start": a, "char_end": b, "window_index": i, "window_total": n, "text": own})
    return kept


def source_kind(path: str, text: str, size: int) -> str:
    end = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if end in MARKDOWN_ENDS:
        return "markdown"
    if end in CODE_ENDS:
        return "code"
    return "large_file" if len(text) > max(size * LARGE_FACTOR, LARGE_LEAST) else "text"


def corpus_chunks(docs: DataFrame, size: int = 1024, overlap: int = 100) -> DataFrame:
    """Chunks of (document_id, source_path, text): CORPUS, and the overlap with the chunks before and after.

    The path's ending tells Markdown and code; other long texts are large files.  Markdown is cut at headings, each section
    knowing the titles above it, code at symbols; sections longer than `size` are cut into windows that end at a paragraph
    or line, the last one with its section.  A null or empty text has no chunks; texts that two rows share are chunked twice."""
    names = [c.split()[0] for c in CORPUS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = []
            for doc, path, text in zip(pdf["document_id"], pdf["source_path"], pdf["text"]):
                kind = source_kind(path, text, size)
                ends = [m.start() for m in re.finditer("\n", text)]
                line = lambda at: bisect.bisect_left(ends, at) + 1  # noqa: B023, E731
                for n, c in enumerate(_pieces(text, kind, size, overlap)):
                    out.append({"document_id": doc, "chunk_id": f"{doc}_chunk_{n:04d}", "chunk_index": n, "source_type": kind, "line_start": line(c["char_start"]), "line_end": line(c["char_end"]), **c})
            found = pd.DataFrame(out, columns=names)
            yield found.astype({c: "Int32" for c in ("level", "window_index", "window_total")})

    rows = docs.select(F.col("document_id").cast("string"), F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("text", F.lit("")).alias("text"))
    per = Window.partitionBy("document_id").orderBy("chunk_index")
    found = rows.mapInPandas(run, CORPUS)
    before = F.greatest(F.lit(0), F.coalesce(F.lag("char_end").over(per) - F.col("char_start"), F.lit(0)))
    after = F.greatest(F.lit(0), F.coalesce(F.col("char_end") - F.lead("char_start").over(per), F.lit(0)))
    return found.withColumn("overlap_before", before).withColumn("overlap_after", after)
