"""Source divergence, sentence pieces and collocations against plain Python and the sentencepiece library."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import SCHEMA, messy_rows, prose, rows_of
from pyspark.sql import functions as F

from meterlab.llm import twins
from meterlab.llm.collocations import collocations
from meterlab.llm.divergence import kept_counts, shares, source_divergence
from meterlab.llm.pieces import Pieces, decode, encode
from meterlab.llm.queries import piece_model
from meterlab.llm.tallies import Merger, pack

LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MODEL = piece_model("piece_bpe_32k.model")


def brute_divergence(rows, min_docs=3, top=200):
    docs = [((x or ""), (y or ""), [t.translate(LOWERED) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, x, y, *_ in rows]
    held, counts, groups = defaultdict(set), Counter(), defaultdict(set)
    for i, (lang, source, terms) in enumerate(docs):
        groups[lang].add(source)
        for t in terms:
            held[lang, t].add(i)
            counts[lang, source, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in held.items() if x == lang and len(d) >= min_docs]

        def shared(n):
            total = sum(n.values()) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // total for t in kept}

        by = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        p = {s: shared(by[s]) for s in sources}
        q = shared({t: sum(by[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t])**2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t])**2 // q[t], t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(items) if part == "pair" or i < top]
    return sorted(out, key=repr)


def term_rows():
    rng = random.Random(4)
    extra = [(100 + i, f"rare{i % 7}, Rare{i % 7}! (rare{i % 7}) " + prose(rng, 12), "en", f"s{i % 3}", 1) for i in range(14)]
    extra += [(300, "once,once Once ONCE", "en", "s1", 1), (301, "once.", "en", "s2", 1), (302, "12 34 ?!", "xx", "s1", 1), (303, None, "xx", None, 1),
              (304, "É é É", "en", None, 1), (305, "é", "en", "s1", 1), (306, "a'É b_é", "en", "s1", 1)]
    return messy_rows() + extra


def test_divergence(spark, empty):
    rows = term_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_divergence(rows)
    got = source_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert rows_of(got) == want
    assert rows_of(source_divergence(docs, top=3)) == brute_divergence(rows, top=3)
    assert rows_of(source_divergence(docs.repartition(5), min_docs=2)) == brute_divergence(rows, 2)
    assert any(r[0] == "xx" and r[4] == 0 for r in want)  # a language without kept terms
    own = docs.withColumns({n: F.lit("own") for n in ("row", "term", "n", "bucket", "packed", "chunk", "total")})
    assert rows_of(source_divergence(own)) == want
    assert source_divergence(empty).count() == 0
    with pytest.raises(ValueError):
        kept_counts(docs, 4)


def test_divergence_twin(spark):
    documents = spark.createDataFrame(term_rows(), SCHEMA).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    assert sorted(con.execute(twins.OP11).fetchall(), key=repr) == brute_divergence(term_rows())


@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=5), st.integers(1, 9 * 10**15 // 2))
@settings(max_examples=60, deadline=None)
def test_shares_are_exact(counts, total):
    counts = [min(c, total - 1) for c in counts]  # a total counts its parts, and one more for each kept term
    got = shares(np.array(counts, np.int64), np.int64(total))
    assert got.tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


@given(st.lists(st.tuples(st.text(max_size=4), st.integers(0, 2), st.integers(0, 9)), max_size=60), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_packed_entries_merge(entries, buckets):
    held = [Merger(["n"], {"n": "sum"}) for _ in range(buckets)]
    for part in (entries[:20], entries[20:]):
        if part:
            batch = pack(pa.array([t for t, *_ in part], pa.string()), np.array([g for _, g, _ in part]), ["x", "ÿ", '"'], [np.array([n for *_, n in part])], buckets)
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                held[b].add(packed)
    want, got = Counter(), Counter()
    for t, g, n in entries:
        want[t, ["x", "ÿ", '"'][g]] += n
    for m in held:
        table = m.table()
        for r in table.to_pylist() if table is not None else []:
            assert (r["text"], m.labels[r["label"]]) not in got
            got[r["text"], m.labels[r["label"]]] = r["n"]
    assert got == want


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def same_as_library(library, texts):
    pieces = Pieces.shared(MODEL)
    ids, n = pieces.encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_eos=True) for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want
    assert pieces.decode(ids, n).to_pylist() == [library.decode(x) for x in want]


def test_pieces_of_odd_texts(library):
    same_as_library(library, ["", None, " ", "  two  spaces ", *[" " * n + "the" for n in range(1, 50)], *[" " * n for n in range(1, 50)], "x" * 5000, "ab" * 900 + " " * 400,
                              "a▁b ▁▁ c", "<s> </s> <unk> <0x0A>", "a\x00b", "é É ß \U0001F600\U0001F600 日本語 한국어 ﷽", "\n\n\t\r x", "ÿþ͸͹", "1234567 89", "thethe" * 300])


@given(st.lists(st.text(st.sampled_from("abcdehinorst ▁\n.,é\U0001F6001")), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_of_short_alphabets(library, texts):
    same_as_library(library, texts)


@given(st.lists(st.text(st.characters(exclude_categories=("Cs",))), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_pieces_of_any_text(library, texts):
    same_as_library(library, texts)


@given(st.lists(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258), st.just(29871)), max_size=12), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_decoding_of_any_ids(library, lists):
    flat, n = np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists])
    assert Pieces.shared(MODEL).decode(flat, n).to_pylist() == [library.decode(x) for x in lists]


def test_pieces_of_documents(messy, empty, library):
    rows = messy_rows()
    own = messy.withColumns({n: F.lit("own") for n in ("ids", "__text", "n")})
    for docs in (messy, own):
        got = decode(encode(docs, MODEL), MODEL).collect()
        want = [(r[0], library.encode(r[1] or "", add_eos=True)) for r in rows]
        assert sorted(((r.doc_id, list(r.ids), r.text) for r in got), key=repr) == sorted(((d, x, library.decode(x)) for d, x in want), key=repr)
    assert decode(encode(empty, MODEL), MODEL).count() == 0


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(MODEL)
    spec.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        Pieces(spec.SerializeToString())


def brute_collocations(rows, least, limit, cover=80):
    grams, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    grams[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in grams.items():
        candidates = {x: a for x, a in f.items() if len(x) > 1 and a >= least}
        found = []
        for x, a in candidates.items():
            if any(len(y) > len(x) and 100 * b >= cover * a and any(y[i:i + len(x)] == x for i in range(len(y))) for y, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (f[x[:k]] + f[x[k:]]), k) for k in range(1, len(x)))
            found.append((-score, -a, " ".join(x).encode(), f[x[:k]], f[x[k:]]))
        out += [(lang, i + 1, x.decode(), -a, m, r, totals[lang], -s) for i, (s, a, x, m, r) in enumerate(sorted(found)[:limit])]
    return sorted(out, key=repr)


def phrase_rows():
    rng = random.Random(9)
    chain = "alpha beta gamma delta"
    rows = [(i, f"{chain if i % 3 else 'alpha beta gamma'} x{i % 5}. Kay\tELL  kay ell, {prose(rng, 20)}\nof the {rng.choice('abcdef')} the of", ("en", None, "und", "fr")[i % 4], "s", 1) for i in range(60)]
    return messy_rows() + rows


@pytest.mark.parametrize(("least", "limit", "width"), [(3, 2000, 4000), (3, 15, 6), (2, 40, 1)])
def test_collocations(spark, least, limit, width):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations(docs, least, limit, width=width)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == brute_collocations(rows, least, limit)


def test_collocations_of_odd_tables(spark, empty):
    rows = phrase_rows()
    own = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in ("phrase", "a", "tau", "score", "packed", "place")})
    assert rows_of(collocations(own, 6, 50)) == brute_collocations(rows, 6, 50)
    assert collocations(empty).count() == 0
    assert collocations(own.limit(5), 1000).count() == 0


def mirrored(n):
    """A text of a Thue-Morse sequence and its twin, on which sums of powers agree for any base."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_mirrored_texts_are_told_apart(spark, n):
    from tokenizers import Tokenizer

    from meterlab.llm.jaccard import similar_groups
    from meterlab.llm.queries import vocabulary
    from meterlab.llm.substrings import remove_repeats
    from meterlab.llm.tokens import Encoder

    a, b = mirrored(n)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        raw, model = (a + b).encode(), Tokenizer.from_str(vocabulary(name))
        ids, size = Encoder(vocabulary(name))(np.frombuffer(raw, np.uint8), np.array([0, n, 2 * n]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [model.encode(x, add_special_tokens=False).ids for x in (a, b)]
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    assert [r.component_id for r in similar_groups(docs).orderBy("doc_id").collect()] == [1, 2]
    words = [f"w{i}" for i in range(33)]
    docs = spark.createDataFrame([(i, " ".join([*words[:30], x, *words[30:]])) for i, x in ((1, a), (2, b))], "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 0, 2: 30}


def test_mix_reruns_agree_on_rows_of_one_id(spark):
    from meterlab.llm.mixing import mix, plan, sized

    rows = [(1, "w " * n, "en", s, 1) for n in (3, 9, 4, 7, 2) for s in ("a", "b", "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [rows_of(plan(sized(docs.repartition(n))).select("doc_id", "size", "source", "taken")) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]
    own = docs.withColumns({n: F.lit("own") for n in ("whole", "rest", "taken", "__id", "__take")})
    assert rows_of(mix(own).select(*docs.columns)) == rows_of(mix(docs)) and mix(own).where("whole <> 'own'").isEmpty()


def test_pipeline_keeps_own_columns(messy):
    import corpus_pipeline

    names = ("score", "rejected", "lang_pred", "n_words", "n_removed", "kept_sha256", "whole", "rest", "__id", "__n", "component_id")
    own = messy.where("doc_id is not null").withColumns({n: F.lit("own") for n in names})
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(messy.sparkSession, own, "")
        assert out.columns == own.columns
        rows = out.collect()
        assert rows and all(r[n] == "own" for r in rows for n in names), name
