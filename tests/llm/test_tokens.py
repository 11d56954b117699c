"""Packing and the token file against the tokenizers library, text by text."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import messy_rows

from meterlab.llm.bytes import utf8
from meterlab.llm.huffman import Decoder, canonical_codes, code_lengths, encode_bits, read_tokens, write_tokens
from meterlab.llm.packing import best_cuts, candidates, pack
from meterlab.llm.queries import vocabulary
from meterlab.llm.tokens import Encoder

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def reference(name, text):
    from tokenizers import Tokenizer

    cached = reference.__dict__.setdefault("models", {})
    if name not in cached:
        cached[name] = Tokenizer.from_str(vocabulary(name))
    return cached[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet=list("aB. ,'\n\t 　é́×—\x1c\x85Σ1<|>"), max_size=30), st.text(max_size=20)), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    ids, counts = Encoder.shared(vocabulary(name))(*utf8(pa.array(texts, pa.string())))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at:at + n].tolist() == reference(name, text)
        at += n
    assert at == len(ids)


def test_special_tokens_are_kept():
    for name in (WORD, BYTE):
        text = "The <|endoftext|> B <|STARTOFTEXT|>x"
        assert Encoder.shared(vocabulary(name))(*utf8(pa.array([text])))[0].tolist() == reference(name, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 5))
def test_cuts_are_the_cheapest(steps, cost):
    at = np.concatenate([[0], np.cumsum(steps)])
    costs = np.array([0.0] + [cost * (i % 2) for i in range(len(steps))])
    length, best = 9, {0: 0.0}
    for j in range(1, len(at)):
        best[j] = min(best[i] + length - (at[j] - at[i]) + costs[j] for i in range(j) if at[j] - at[i] <= length)
    cuts, total, last = best_cuts(at, costs, length), 0.0, 0
    for j in cuts:
        assert at[j] - at[last] <= length
        total += length - (at[j] - at[last]) + costs[j]
        last = j
    assert last == len(at) - 1 and total == pytest.approx(best[last])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 3)), min_size=1, max_size=8), st.integers(2, 9), st.integers(0, 6), st.integers(0, 9), st.randoms())
def test_cuts_anywhere_in_wide_stretches_are_the_cheapest(sizes, length, soft, extra, rng):
    ends = np.cumsum([n for n, _ in sizes])
    ids = np.zeros(int(ends[-1]), np.uint32)
    for (n, marks), end in zip(sizes, ends, strict=True):
        for _ in range(marks):
            ids[end - 1 - rng.randrange(n)] = 1
    hard = soft + extra
    own = {0, *ends.tolist(), *(np.flatnonzero(ids) + 1).tolist()}
    price = {p: 0 if p in ends else soft for p in own}
    for a, b in zip(sorted(own), sorted(own)[1:], strict=False):
        price |= {p: hard for p in range(a + 1, b) if b - a > length}
    best = {0: 0}
    for p in range(1, len(ids) + 1):
        if p in price:
            best[p] = price[p] + min(best[q] + length - (p - q) for q in range(max(0, p - length), p) if q in best)
    at, cost = candidates(ids, ends, np.array([False, True]), length, soft, hard)
    assert all(price[p] == c for p, c in zip(at[1:].tolist(), cost[1:].tolist(), strict=True))
    cuts = at[best_cuts(at, cost, length)].tolist()
    assert cuts[-1] == len(ids)
    assert sum(price[p] + length - (p - q) for q, p in zip([0, *cuts], cuts, strict=False)) == best[len(ids)]


@pytest.mark.parametrize("n", [2100, 3000, 4100])
def test_texts_without_sentences_are_packed_tightly(spark, n):
    rows = [(i, " ".join(["the"] * (n - 1))) for i in range(60)]
    pieces = pack(spark.createDataFrame(rows, "doc_id bigint, text string"), vocabulary(WORD)).collect()
    by_seq = check_pieces(pieces, rows)
    assert sum(p.length for p in pieces) == 60 * n
    assert 60 * n / (2048 * len(by_seq)) > 0.95


def check_pieces(pieces, rows, length=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = np.array([*reference(WORD, text), 1], "<u4")
        want[doc_id].append(ids)
    assert set(by_doc) == set(want)
    for doc_id, all_ids in want.items():
        own = by_doc[doc_id]
        assert sum(p.length for p in own) == sum(map(len, all_ids))
        for p in own:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for ids in all_ids)
        if len(all_ids) == 1:
            at = 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at
                at += p.length
    return by_seq


def test_pack(messy, empty, clashing):
    tokenizer = vocabulary(WORD)
    pieces = pack(messy, tokenizer).collect()
    by_seq = check_pieces(pieces, messy_rows())
    fill = sorted(sum(p.length for p in own) for own in by_seq.values())
    assert sum(fill[-len(fill) // 2:]) / len(fill[-len(fill) // 2:]) > 0.9 * 2048
    assert pack(empty, tokenizer).count() == 0
    assert sorted(pack(clashing, tokenizer).collect(), key=repr) == sorted(pieces, key=repr)


def test_pack_in_runs(messy, monkeypatch):
    monkeypatch.setattr("meterlab.llm.packing.RUN", 500)
    check_pieces(pack(messy, vocabulary(WORD), length=256).collect(), messy_rows(), 256)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=40), st.integers(6, 12))
def test_code_lengths_are_optimal(counts, bits):
    counts = np.array(counts)
    lengths = code_lengths(counts, bits)
    used = counts > 0
    assert (lengths[~used] == 0).all() and (lengths[used] <= bits).all()
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1.0
        import heapq

        heap, cost = [int(c) for c in counts[used]], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        got = int((counts * lengths.astype(int)).sum())
        assert got >= cost and (got == cost or lengths.max() == bits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=700))
def test_codes_round_trip(ids):
    ids = np.array(ids)
    lengths = code_lengths(np.bincount(ids, minlength=301), 12)
    bits, start = encode_bits(ids, canonical_codes(lengths), lengths)
    assert Decoder(lengths)(bits, start[::128], len(ids)).tolist() == ids.tolist()


def test_token_file(spark, messy, empty, clashing, tmp_path):
    tokenizer = vocabulary(BYTE)
    path, lengths = write_tokens(messy, tokenizer, 0, path=str(tmp_path / "tokens"))
    got = sorted(read_tokens(spark, path, lengths).collect(), key=lambda r: r.start)
    want = sorted(messy_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (doc_id, text, *_) in zip(got, want, strict=True):
        ids = np.array([*reference(BYTE, text), 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (doc_id, at, len(ids), ids.tobytes())
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    path, lengths = write_tokens(empty, tokenizer, 0)
    assert read_tokens(spark, path, lengths).count() == 0
    path, lengths = write_tokens(clashing, tokenizer, 0)
    assert read_tokens(spark, path, lengths, with_ids=False).count() == len(want)


def test_token_file_is_read_by_its_path_alone(spark, messy, empty, tmp_path):
    tokenizer = vocabulary(BYTE)
    path, lengths = write_tokens(messy, tokenizer, 0, path=str(tmp_path / "tokens"))
    want = sorted(map(tuple, read_tokens(spark, path, lengths).collect()), key=repr)
    other = spark.newSession()
    assert sorted(map(tuple, read_tokens(other, str(tmp_path / "tokens")).collect()), key=repr) == want
    assert len(want) == messy.count()
    assert read_tokens(other, write_tokens(empty, tokenizer, 0)[0]).count() == 0
