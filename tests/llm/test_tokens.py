import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerline.llm import bpe, chunks, common, packing, token_files, tokens
from ledgerline.llm.elias_fano import EliasFano

from .conftest import ODD

PIECES = [*"abcth e  \n\t'sé日🙂12.!?　\x85\x1c<|", "<|endoftext|>", "<|endoftext", "  "]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


@pytest.fixture(scope="session")
def ranks(vocabularies):
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{vocabularies}/byte_bpe_multi_50k.tiktoken", "rb"))}


@pytest.fixture(scope="session")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="session")
def pairs(ranks):
    return bpe.BytePairs(ranks)


@pytest.fixture(scope="session")
def data(vocabularies):
    return open(f"{vocabularies}/byte_bpe_50k.json", "rb").read()


def split(flat, starts):
    return [flat[a:z].tolist() for a, z in zip(starts[:-1], starts[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_backtracking_equals_merging(pairs, library, texts):
    assert split(*chunks.encoded(pa.array(texts), pairs)) == [library.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=5))
def test_chunks_equal_whole_texts(data, texts):
    plain = Tokenizer.from_str(data.decode())
    assert split(*chunks.encoded(pa.array(texts), tokens.Encoder(data))) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    plain.encode_special_tokens = True
    assert split(*chunks.encoded(pa.array(texts), tokens.Encoder(data, literal=True))) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_special_strings_as_the_library_takes_them(data):
    assert split(*chunks.encoded(pa.array(["a<|endoftext|>b", "  <|endoftext|>   ", "<|endoftext|><|endoftext|> x <|endoftext"]), tokens.Encoder(data)))[0] == [64, 50256, 65]


def test_long_pieces_take_linear_time(pairs, library):
    for t in ("a" * 20_000, "ab" * 9000, "é" * 8000, " " * 20_000):
        assert split(*chunks.encoded(pa.array([t]), pairs)) == [library.encode_ordinary(t)]


def test_full_memories_change_nothing(ranks, library):
    own = bpe.BytePairs(ranks)
    own.PAIRS, own.PIECES = 3, 2
    t = "the theory of everything, then others, then more others"
    assert split(*chunks.encoded(pa.array([t, t]), own)) == [library.encode_ordinary(t)] * 2


def test_bpe_round_trip(spark, odd, nothing, vocabularies, library):
    path = f"{vocabularies}/byte_bpe_multi_50k.tiktoken"
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.token_digests(odd, path).collect())
    want = Counter()
    for i, t in ODD:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want and bpe.token_digests(nothing, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900).map(sorted))
def test_elias_fano(values):
    e = EliasFano.from_bytes(EliasFano.build(np.array(values, np.int64)).to_bytes())
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values


def test_token_files(spark, odd, nothing, vocabularies, tmp_path):
    where = f"{vocabularies}/byte_bpe_50k.json"
    t = Tokenizer.from_file(where)
    token_files.write_token_files(odd, str(tmp_path / "f"), where, block_ids=500)
    got = [tuple(r) for r in token_files.checksums(token_files.read_token_files(spark, str(tmp_path / "f"))).collect()]
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    first = spark.read.parquet(str(tmp_path / "f")).filter("shard = 0 and block = 0").first()
    assert len(token_files.document_ids(spark, str(tmp_path / "f"), 1)) == want[1][2] and first["doc_ids"][1] == want[1][0]
    token_files.write_token_files(nothing, str(tmp_path / "e"), where)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        room.append((room.pop(room.index(min(fits))) if fits else capacity) - n)
    return sorted(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_document_by_document_best_fit(lengths):
    plan, bins = packing.best_fit_plan(Counter(lengths), 40)
    used, counts = Counter(), Counter(lengths)
    for length in counts:
        rows = sorted(r for r in plan.tolist() if r[0] == length)
        for k in range(counts[length]):
            _, first, bin_, each, offset = [r for r in rows if r[1] <= k][-1]
            used[bin_ + (k - first) // each] += length
    assert len(used) == bins and sorted(40 - n for n in used.values()) == best_fit(lengths, 40)


def test_packing(spark, odd, nothing, vocabularies):
    where = f"{vocabularies}/byte_bpe_50k.json"
    t = Tokenizer.from_file(where)
    rows = packing.pack_documents(odd, where, capacity=256, with_ids=True).collect()
    whole = Counter(tuple([*t.encode(x or "", add_special_tokens=False).ids, 0]) for _, x in ODD)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 256 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert any(w[r["start"] : r["start"] + r["length"]] == tuple(ids.tolist()) for w in whole)
        assert r["piece"] == 0 or r["length"] == 256
    assert sum(r["length"] for r in rows) == sum(len(w) * n for w, n in whole.items())
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len({r["sequence_id"] for r in rows}) == len(best_fit([r["length"] for r in rows], 256))
    assert packing.sequences(packing.pack_documents(odd, where, capacity=256, with_ids=True)).count() == len({r["sequence_id"] for r in rows})
    assert packing.pack_documents(nothing, where).count() == 0


def test_decoding_keeps_nulls_and_other_columns(spark, vocabularies, library, monkeypatch):
    path = f"{vocabularies}/byte_bpe_multi_50k.tiktoken"
    texts = ["a few words", "", None, "more words than a step of three ids holds", "x"]
    rows = [(k, None if t is None else library.encode_ordinary(t), f"o{k}") for k, t in enumerate(texts)]
    monkeypatch.setattr(bpe, "STEP_IDS", 3)
    got = bpe.bpe_decode(spark.createDataFrame(rows, "decoding int, ids array<int>, other string"), path).collect()
    assert [(r["decoding"], r["other"], None if r["decoded"] is None else bytes(r["decoded"]).decode()) for r in got] == [(k, f"o{k}", t) for k, t in enumerate(texts)]


def test_single_documents_of_any_block(spark, vocabularies, tmp_path):
    t = Tokenizer.from_file(f"{vocabularies}/byte_bpe_50k.json")
    rows = [(i, " ".join(f"word{k}" for k in range(i % 17))) for i in range(200)]
    where = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), where, f"{vocabularies}/byte_bpe_50k.json", block_ids=300)
    blocks = spark.read.parquet(where).select("shard", "block", "doc_ids").collect()
    assert len(blocks) > 3 and sum(len(b["doc_ids"]) for b in blocks) == 200
    for b in blocks[:: max(1, len(blocks) // 4)]:
        for place in (0, len(b["doc_ids"]) // 2, len(b["doc_ids"]) - 1):
            want = [*t.encode(rows[b["doc_ids"][place]][1], add_special_tokens=False).ids, 0]
            assert token_files.document_ids(spark, where, place, b["shard"], b["block"]) == want


def test_workers_keep_vocabularies_only_where_asked():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    for keep in (True, False):
        common.kept["tokenizer", "some"] = object()
        assert list(common.lean(iter, keep=keep)([batch])) == [batch]
        assert (("tokenizer", "some") in common.kept) == keep
    common.forget()
