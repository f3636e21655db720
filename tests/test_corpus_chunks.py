"""Chunks of a corpus on hand-made texts, and windows against a plain loop."""

import random

from lorewell.operators import chunk
from lorewell.operators.chunk import _pieces, aligned, corpus_chunks, source_kind, spans


def test_sections_know_the_titles_above_them():
    text = "# Intro\nThis is intro text.\n\n## Details\n- item 1\n- item 2\n\n## Notes\nFinal section with extra details for chunking.\n# Other\nx"
    got = _pieces(text, "markdown", 120, 20)
    assert [(c["title"], c["level"], c["path"]) for c in got] == [("Intro", 1, "Intro"), ("Details", 2, "Intro > Details"), ("Notes", 2, "Intro > Notes"), ("Other", 1, "Other")]
    assert got[1]["text"] == "## Details\n- item 1\n- item 2" and got[1]["char_start"] == text.index("## Details")


def test_short_beginnings_join_the_next_section():
    text = "short\n# A\n" + "a" * 50 + "\n# B\n" + "b" * 200
    got = _pieces(text, "markdown", 400, 20)
    assert [(c["title"], c["char_start"], c["char_end"]) for c in got] == [("preamble", 0, len(text))]
    assert _pieces("no heading " * 3, "markdown", 400, 20)[0]["title"] == "document"


def test_code_and_large_files():
    code = "import os\n\ndef one():\n    pass\n\nclass Two:\n    def three(self):\n        return 3\n"
    assert [c["title"] for c in _pieces(code, "code", 500, 0)] == ["module_preamble", "one", "Two", "three"]
    assert [c["title"] for c in _pieces("x = 1\n", "code", 500, 0)] == ["module"]
    large = "word " * 5000
    assert source_kind("a.txt", large, 1024) == "large_file" and source_kind("b/c.MD", "", 9) == "markdown" and source_kind("x.d/readme", "", 9) == "text"
    got = _pieces(large, "large_file", 1024, 100)
    assert [c["window_index"] for c in got] == list(range(got[0]["window_total"])) and got[0]["char_end"] == 1200


def test_windows_equal_a_plain_loop():
    rng = random.Random(1)
    for _ in range(500):
        n, size = rng.randint(0, 60), rng.randint(1, 20)
        overlap = rng.randint(0, size + 3)
        want, start = [], 0
        while start < n:
            want.append((start, min(n, start + size)))
            if start + size >= n:
                break
            start += max(1, size - overlap)
        assert spans(n, size, overlap) == want
    assert aligned("aaa\n\nbbb\nccc ddd", 0, 12) == 5 and aligned("aaa bbb", 0, 3) == 3 and aligned("aaa", 0, 9) == 3


def test_table(spark):
    rows = [("m", "x.md", "# T\n" + "para one.\n\n" * 60), ("n", "x.txt", None), ("e", None, ""), ("t", "y.txt", "w " * 400)]
    got = corpus_chunks(spark.createDataFrame(rows, "document_id string, source_path string, text string"), 180, 40).collect()
    assert {r.document_id for r in got} == {"m", "t"} and all(r.overlap_after >= 0 for r in got)
    own = sorted((r.chunk_index, r.overlap_before, r.overlap_after) for r in got if r.document_id == "t")
    assert all(a[2] == b[1] == 40 for a, b in zip(own, own[1:]))


def test_chunks_of_a_few_texts_are_held_at_once():
    import pandas as pd

    parts = list(chunk.few(iter([pd.DataFrame({"a": range(250)}), pd.DataFrame({"a": []})])))
    assert [len(p) for p in parts] == [100, 100, 50] and [x for p in parts for x in p["a"]] == list(range(250))
