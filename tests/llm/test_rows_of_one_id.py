"""Rows under one id, and rows without one, keep to their own lists."""

import pytest
import xxhash

from contentloom.llm import line_dedup, sidelists, substring_dedup


def alike(text, made):
    """A text of ``made`` whose hash ends in the same 16 bits as that of ``text``."""
    tag = xxhash.xxh3_64_intdigest(text) & 0xFFFF
    return next(x for x in map(made, range(10**7)) if xxhash.xxh3_64_intdigest(x) & 0xFFFF == tag)


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("key", [None, 7])
def test_lists_of_other_texts_cut_nothing(spark, table, monkeypatch, limit, key):
    monkeypatch.setattr(sidelists, "SEND_BYTES", limit)
    passage = " ".join(f"p{i}" for i in range(20))
    copy = f"{passage}\nsecond line of the copy"
    clean = alike(copy, lambda k: " ".join(f"c{k}x{i}" for i in range(20)) + "\nanother text")
    again = alike(copy, lambda k: f"{passage}\nnumber {k} is the last line here")
    docs = table([(1, passage), (key, copy), (key, clean), (key, again)])
    lines = {r.text: r["__n_removed"] for r in line_dedup.deduplicated(docs).collect()}
    assert lines == {passage: 0, copy.split("\n")[1]: 1, clean: 0, again.split("\n")[1]: 1}
    words = {r.text: r["__n_removed"] for r in substring_dedup.deduplicated(docs).collect()}
    assert words == {passage: 0, copy.split("\n")[1]: 20, clean: 0, again.split("\n")[1]: 20}
