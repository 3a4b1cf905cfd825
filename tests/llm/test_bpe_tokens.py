"""BPE against the tokenizers library, token files against a plain scan."""
import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spendlake.llm import bpe, token_counts
from tests.llm.conftest import odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def machine():
    return bpe.MergeAutomaton(bpe.read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(machine, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(machine.encode(text), "<u4")
    assert got.tolist() == want, repr(text[:80])
    assert machine.decode(got) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(machine, library, text):
    same(machine, library, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeth ing'sr0\né.", max_size=200))
def test_dense_merges(machine, library, text):
    same(machine, library, text)


def test_runs_specials_and_long_words(machine, library):
    for t in ("a" * 9000, "ab" * 3000, " " * 700, "-" * 400, "<|endoftext|>x<|endoftext|><|endoftext|>", "<|endoftext", "\x1c\x85\xa0  "):
        same(machine, library, t)


def test_small_memory_gives_the_same_paths(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    monkeypatch.setattr(bpe, "MEMORY_MOVES", 5)
    m = bpe.MergeAutomaton(bpe.read_spec(PATH))
    for k in range(20):
        same(m, library, prose(k, 40))


def test_columns_and_odd_rows(docs_of, library):
    df = docs_of(odd_rows()).selectExpr("*", "'old' AS ids", "7 AS n_tokens")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        assert r["decoded"] == (r["text"] or "") and r["n_tokens"] == 7
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    d = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs_of(odd_rows()), PATH).collect()}
    for i, t in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in d


def test_empty_table(docs_of):
    assert bpe.digests(docs_of([]), PATH).collect() == []


def write(folder, name, ids, width=2):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(np.array(ids, f"<u{width}").tobytes())


def plain(ids, eod):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == eod:
            out.append((len(out), start, k - start, True))
            start = k + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("block,segment", [(1, 2), (3, 2), (7, 3), (1000, 1024)])
def test_separator_scan_stitches_blocks(spark, tmp_path, monkeypatch, block, segment):
    monkeypatch.setattr(token_counts, "SEGMENT", segment)
    rng = np.random.default_rng(block)
    files = {"a.tok": rng.integers(0, 4, 200).tolist(), "b.tok": [], "c.tok": [0], "d.tok": [1] * 50, "e.tok": [0, 0, 5, 0]}
    for n, ids in files.items():
        write(tmp_path / "t", n, ids)
    listed = token_counts.list_files(spark, str(tmp_path / "t"))
    got = {}
    for r in token_counts.count_tokens(spark, listed, eod=0, block_tokens=block).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["doc_no"], r["start"], r["n_tokens"], r["closed"]))
    for n, ids in files.items():
        assert sorted(got.get(n, [])) == plain(ids, 0), n


def test_four_byte_files(spark, tmp_path):
    write(tmp_path / "w", "x.tok", [70000, 9, 1, 70000, 70000], width=4)
    rows = token_counts.count_tokens(spark, token_counts.list_files(spark, str(tmp_path / "w")), eod=70000, width=4, block_tokens=2).collect()
    assert sorted((r["doc_no"], r["n_tokens"]) for r in rows) == [(0, 0), (1, 2), (2, 0)]


def test_document_counts(docs_of):
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = token_counts.document_counts(docs_of(odd_rows()), RANKS, 50256).collect()
    want = sorted(((i if i is not None else -1), len(enc.encode_ordinary(t or ""))) for i, t in odd_rows())
    assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_tokens"]) for r in rows) == want
    assert token_counts.document_counts(docs_of([]), RANKS, 50256).collect() == []
