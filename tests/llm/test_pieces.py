import hashlib
import struct

import numpy as np
import pytest

from sheaf.llm import pieces
from sheaf.llm.common import table
from sheaf.llm.queries import op8_pieces, tokenizer_path

TEXTS = ["", " ", "Hello  world", "a▁b \t\n", "é ﬁ ㎏ 😀", "x" * 3000, "  lead and trail  ", "日本語 text\x00mixed"]


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_same_as_the_library_and_spans_cover(spark, make_docs, sp):
    got = {r["doc_id"]: r for r in pieces.encode_offsets(make_docs(TEXTS), tokenizer_path()).collect()}
    for i, text in enumerate(TEXTS):
        r, data = got[i], text.encode()
        assert r["ids"] == sp.encode(text) and r["decoded"] == sp.decode(sp.encode(text))
        end = 0
        for a, b in zip(r["starts"], r["ends"], strict=True):
            assert a <= b and a <= end
            end = max(end, b)
        assert end == len(data)
        for piece, a, b in zip(map(sp.id_to_piece, r["ids"]), r["starts"], r["ends"], strict=True):
            if not piece.startswith("<0x"):
                assert piece.replace("▁", " ").strip() == data[a:b].decode().replace("▁", " ").strip()


def test_odd_rows(odd_docs):
    rows = pieces.encode_offsets(odd_docs, tokenizer_path()).collect()
    assert len(rows) == 8 and all(r["ids"] == [] and r["decoded"] == "" for r in rows if not r["text"])
    assert pieces.encode_offsets(odd_docs.limit(0), tokenizer_path()).count() == 0


def test_offsets_are_null_where_pieces_do_not_cover_the_text(monkeypatch):
    one = pieces.Codec(tokenizer_path())
    whole = one.encode("two words")
    monkeypatch.setattr(one, "normalise", lambda data: (np.zeros(1, np.int64), np.ones(1, np.int64)))
    ids, starts, ends, decoded = one.encode("two words")
    assert ids.tolist() == whole[0].tolist() and starts is None and ends is None and decoded == "two words"
    assert pieces._lists([np.array([1, 2]), None, np.array([], dtype=np.int64), np.array([3])]).to_pylist() == [[1, 2], None, [], [3]]
    assert pieces._lists([]).to_pylist() == []


def test_query_against_the_library(spark, sf_dir, sp):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        ids = sp.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    got = op8_pieces(spark, sf_dir).collect()
    assert len(got) == len(want) and {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_decode(spark, sp):
    df = spark.createDataFrame([(1, sp.encode("a b c")), (2, []), (3, None)], "k long, ids array<int>")
    assert {r["k"]: r["decoded"] for r in pieces.decode_ids(df, tokenizer_path()).collect()} == {1: "a b c", 2: "", 3: ""}


def double_array(keys):
    """A small double-array trie of (key, value): one free slot is found for each node by trying."""
    root: dict = {}
    for key, value in keys:
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[None] = value
    units = [0] * 4096
    used = {0}

    def place(node, at, label):
        base = next(o for o in range(1, 2048) if all((o ^ (c if c is not None else 0)) not in used for c in node))
        offset = base ^ at
        while offset >= 1 << 21:
            raise AssertionError
        units[at] = (offset << 10) | (label if label is not None else 0) | (0x100 if None in node else 0)
        for c in node:
            used.add(base ^ (c or 0))
        for c, child in node.items():
            if c is None:
                units[base] = 0x80000000 | child
            else:
                place(child, base ^ c, c)

    place(root, 0, None)
    return struct.pack("<I4096I", 4 * 4096, *units)


def test_longest_prefix_of_a_character_map(sp):
    pool = b"k\0kg\0fi\0"
    blob = double_array([("㎏".encode(), 2), ("ﬁ".encode(), 5), ("㎏x".encode(), 0)]) + pool
    one = pieces.Codec(tokenizer_path())
    one.charmap = pieces.CharMap(blob)
    assert one.charmap.longest("a㎏".encode(), 1) == (3, b"kg") and one.charmap.longest("㎏x!".encode(), 0) == (4, b"k") and one.charmap.longest(b"zz", 0) is None
    starts, ends = one.normalise("ﬁ ㎏".encode())
    # dummy prefix, f, i, the space mark, k, g
    assert list(zip(starts, ends, strict=True)) == [(0, 0)] * 3 + [(0, 3)] * 2 + [(3, 4)] * 3 + [(4, 7)] * 2


def test_plain_and_general_ways_agree():
    one = pieces.Codec(tokenizer_path())
    for t in TEXTS:
        for a, b in zip(one._plain(t.encode()), one._general(t.encode()), strict=True):
            assert np.array_equal(a[3:], b[3:]) and len(a) == len(b)
