"""Sharding, line rules, substring and near-duplicate operators, mixing, fingerprints, language and quality."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from llm.conftest import SCHEMA, messy_rows, prose, rows_of
from pyspark.sql import functions as F

from meterlab.llm import twins
from meterlab.llm.components import components
from meterlab.llm.ctph import edited, fingerprint_documents, of_texts
from meterlab.llm.jaccard import Trie, one_per_group, similar_groups, trie_links
from meterlab.llm.langid import identify, keep_identified
from meterlab.llm.linefreq import line_frequency
from meterlab.llm.mixing import count_words, mix, plan, sized
from meterlab.llm.ordering import running
from meterlab.llm.pulearn import classify, features, train
from meterlab.llm.sharding import permuted, shard
from meterlab.llm.substrings import least, remove_repeats


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 99, 100, 101, 1000])
def test_permutation_is_one_to_one(spark, n):
    got = spark.range(n).select(permuted(F.col("id"), n, 3).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_shards(messy, empty, clashing):
    got = shard(messy, 5).collect()
    rows = messy_rows()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(5)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert rows_of(shard(messy.repartition(7), 5)) == sorted((tuple(r) for r in got), key=repr) == rows_of(shard(clashing, 5))
    assert shard(empty, 5).count() == 0


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("k"), (F.col("id") % 11).alias("v")).repartition(6)
    rows = running(df, ["k"], {"before": "v"}, count="row")[0].orderBy("k").collect()
    total = 0
    for i, r in enumerate(rows):
        assert (r.row, r.before) == (i, total)
        total += r.v


def test_count_words(spark, messy):
    for r in messy.select("text", count_words(F.col("text")).alias("n")).collect():
        assert r.n == (None if r.text is None else len(brute.words(r.text)))


def test_line_rules(messy, empty, clashing):
    got = line_frequency(messy, min_docs=2, share=0.1)
    want = []
    for doc_id, text, *_ in messy_rows():
        w, t = brute.words(text), text or ""
        lines = [x for x in t.split("\n") if brute.words(x)]
        repeat = brute.repeat_words(w)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got.select(*names)) == sorted(want, key=repr)
    assert rows_of(line_frequency(clashing, min_docs=2, share=0.1).select(*names)) == sorted(want, key=repr)
    assert line_frequency(empty).count() == 0


def test_frequent_lines_deplete(spark):
    rng = random.Random(3)
    common = prose(rng, 20)
    rows = [(i, common + "\n" + prose(rng, 6 if i < 5 else 200), None, "a" if i % 2 else None, 1) for i in range(20)]
    rows += [(20 + i, common.upper() + "\n" + prose(rng, 8), None, "b", 1) for i in range(3)]
    got = {r.doc_id: r for r in line_frequency(spark.createDataFrame(rows, SCHEMA), min_docs=3, share=0.2).collect()}
    assert all(not got[i].kept and got[i].n_left == 6 for i in range(5))
    assert all(got[i].kept and got[i].n_left == 200 for i in range(5, 20))
    assert all(got[i].n_left == 28 for i in range(20, 23))  # three documents of the host are not above the limit


def test_frequent_lines_in_hosts_of_any_size(spark):
    rng = random.Random(8)
    spread = {"small": (20, {"m2": 2, "m3": 3}), "mid": (100, {"m5": 5, "m6": 6}), "hot": (1200, {"h50": 50, "h51": 51})}
    rows, want = [], {}
    for host, (n, lines) in spread.items():
        for i in range(n):
            held = [f"{name} {host} line in common" for name, k in lines.items() if i < k]
            gone = [x for x in held if x[:2] == "m3" or x[:2] == "m6" or x[:3] == "h51"]
            want[len(rows)] = 40 + 5 * (len(held) - len(gone))
            rows.append((len(rows), "\n".join([*held, prose(rng, 40)]), None, host, 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_left for r in line_frequency(docs).collect()} == want
    assert twins.OP3_LARGE_HOSTS != twins.OP3


@pytest.mark.parametrize("limits", [(2, 0.05, 50), (1, 0.0, None), (5, 0.9, 2)])
def test_words_left_without_frequent_lines(messy, limits):
    least, share, always = limits
    host_docs, line_docs, lines = Counter(), defaultdict(set), []
    for row, (_, text, _, source, *_) in enumerate(messy_rows()):
        host_docs[source] += 1
        own = [" ".join(brute.words(x.lower())) for x in (text or "").split("\n") if brute.words(x)]
        lines.append((source, own))
        for x in own:
            line_docs[source, x].add(row)
    common = {(host, x) for (host, x), rows in line_docs.items()
              if len(rows) > least and len(rows) > share * host_docs[host] or always is not None and len(rows) > always}
    assert common
    want = [(doc_id, len(brute.words(text)) - sum(len(x.split(" ")) for x in own if (host, x) in common))
            for (doc_id, text, *_), (host, own) in zip(messy_rows(), lines, strict=True)]
    got = line_frequency(messy, min_docs=least, share=share, always=always)
    assert rows_of(got.select("doc_id", "n_left")) == sorted(want, key=repr)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=20, max_size=40), st.integers(1, 20))
def test_sliding_least(values, width):
    a = np.array(values)
    assert least(a, width).tolist() == [min(values[i:i + width]) for i in range(len(values) - width + 1)]


def check_repeats(df, rows):
    got = sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())
    kept = brute.repeats_removed([(r[0], r[1]) for r in rows])
    assert got == sorted((repr(r[0]), len(brute.words(r[1])), len(brute.words(r[1])) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for r, k in zip(rows, kept, strict=True))


def test_repeats_removed(messy, empty, clashing, monkeypatch):
    check_repeats(remove_repeats(messy), messy_rows())
    check_repeats(remove_repeats(clashing), messy_rows())
    assert remove_repeats(empty).count() == 0
    monkeypatch.setattr("meterlab.llm.substrings.BUCKET_BYTES", 4000)
    check_repeats(remove_repeats(messy), messy_rows())
    texts = {r.doc_id: r.text for r in remove_repeats(messy, all_joined=True).collect()}
    assert texts[51] == brute.repeats_removed([(r[0], r[1]) for r in messy_rows()])[17] or " ".join(brute.words(texts[51])) == texts[51]


def test_repeats_random(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), " ".join(rng.choice("ab") for _ in range(rng.randrange(60))), None, None, 0) for _ in range(60)]
    check_repeats(remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), mini=3), rows)


def test_similar_groups(messy, empty, clashing):
    want = sorted(brute.similar_components([(r[0], r[1]) for r in messy_rows()]), key=repr)
    names = ("doc_id", "n_shingles", "component_id")
    assert rows_of(similar_groups(messy).select(*names)) == want
    assert rows_of(similar_groups(clashing).select(*names)) == want
    assert similar_groups(empty).count() == 0
    kept = one_per_group(messy).collect()
    groups = Counter(w[2] for w in want if w[1])
    assert len(kept) == len(groups) + 1 + sum(not w[1] for w in want)  # two groups have 15 as their least id
    assert one_per_group(messy).columns == messy.columns and one_per_group(empty).count() == 0


def near_family(rng, n, edits, size=150):
    base = prose(rng, size).split(" ")
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(size)] = f"q{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bands,group", [(4, 512), (1, 4), (0, 512)])
def test_similar_groups_lose_no_link(spark, bands, group):
    rng = random.Random(bands)
    texts = near_family(rng, 60, 7) + near_family(rng, 30, 12) + near_family(rng, 10, 3, 20) + [prose(rng, 80) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), max(bands, 1), group)
    if bands == 0:  # everything by the completion
        from meterlab.llm import jaccard

        sets = jaccard._sets_of(spark.createDataFrame(rows, "doc_id bigint, text string"), 1).dropDuplicates(["set_id"])
        links = jaccard._completed(sets, None)
        numbers = jaccard.shingle_sets(pa.record_batch({"text": pa.array(texts)}))[1].view(np.int64).tolist()
        ids = {x: k for k, x in reversed(list(enumerate(numbers)))}
        parent = [ids[x] for x in numbers]  # equal texts are one class

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for r in links.collect():
            a, b = find(ids[r.a]), find(ids[r.b])
            parent[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(texts))] == [c for _, _, c in brute.similar_components(rows)]
    else:
        assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute.similar_components(rows), key=repr)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=14))
def test_trie_joins_what_is_alike(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    trie = Trie()
    parent = list(range(len(sets)))

    def find(p, i):
        while p[i] != i:
            i = p[i]
        return i

    got = list(range(len(sets)))
    for a, b in trie_links(list(range(len(sets))), arrays):
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        x, y = find(got, a), find(got, b)
        got[max(x, y)] = min(x, y)
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    assert [find(got, i) for i in range(len(sets))] == [find(parent, i) for i in range(len(sets))]
    assert trie.sets == []


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {x: x for p in links for x in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_mixing_plan(messy, empty, clashing):
    got = plan(sized(messy)).collect()
    size = defaultdict(int)
    for _, text, _, source, _ in messy_rows():
        size[source] += len(brute.words(text))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute.water_fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    again = lambda df: rows_of(plan(sized(df)).groupBy("source").agg(F.sum("taken")))
    assert again(messy.repartition(5)) == again(clashing)
    assert plan(sized(empty)).count() == 0


def test_mixed_documents(messy, empty):
    out = mix(messy)
    assert out.columns == messy.columns and mix(empty).count() == 0
    texts = {r.text for r in messy.collect()}
    whole = Counter()
    for r in out.collect():
        whole[r.doc_id] += r.text in texts
        assert r.text in texts or any((" ".join(brute.words(t)) + " ").startswith(r.text + " ") for t in texts if t)
    assert rows_of(mix(messy.repartition(4))) == rows_of(out)


def test_fingerprints(spark, messy, empty, clashing):
    got = fingerprint_documents(messy)
    order = sorted(messy_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want = []
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        new = edited(text, after)
        a, b = of_texts([text])[0], of_texts([new])[0]
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    assert rows_of(got.select(*names)) == sorted(want, key=repr) == rows_of(fingerprint_documents(clashing).select(*names))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.collect())
    assert fingerprint_documents(empty).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(4, "abcdefgh", None, None, 8)], SCHEMA)).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_fingerprints_tell_edits_from_strangers(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 300), None, None, 0) for i in range(40)]
    got = fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.6 and got[1] < 0.2


def language_rows(n=240):
    rng = random.Random(2)
    kinds = {"aa": ["tha", "ing", "ere", "ond", "st"], "bb": ["eau", "ien", "oux", "que", "lle"], "cc": ["zzk", "vch", "ßtz", "ung", "wro"]}
    word = lambda k: "".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 4)))
    return [(i, " ".join(word(k) for _ in range(rng.randrange(5, 60))), k, "s", 0) for i in range(n) for k in [rng.choice(list(kinds))]]


def test_languages(spark, messy, empty, clashing):
    rows = language_rows() + [(1000, None, "aa", "s", 0), (1001, "123 !?", None, "s", 0), (1002, "", "bb", "s", 0), (1003, "п" * 200, None, "s", 0), (1004, "THAING ereond", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in identify(docs, F.col("doc_id") % 5 != 0).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows[:240]) >= 236
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1003].rejected and got[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = keep_identified(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {1000, 1001, 1002, 1003} and len(ids) >= 238
    everywhere = F.lit(True)
    assert identify(messy, everywhere).count() == messy.count() == identify(clashing, everywhere).count()
    assert identify(empty, everywhere).count() == 0 and keep_identified(empty).count() == 0


def test_labelled_gibberish_is_rejected(spark):
    rng = random.Random(6)
    clean = language_rows(600)
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    junk = [(1000 + i, " ".join(noise() for _ in range(rng.randrange(30, 80))), "aabbcc"[i % 3 * 2:][:2], "s", 0) for i in range(30)]
    docs = spark.createDataFrame(clean + junk, SCHEMA)
    assert {r.doc_id for r in keep_identified(docs).collect()} == {r[0] for r in clean}
    got = identify(docs, F.col("doc_id") % 5 != 0).collect()
    assert {r.doc_id for r in got if r.rejected} == {r[0] for r in junk}


def test_copies_do_not_make_others_rejected(spark):
    rng = random.Random(7)
    clean = language_rows(300)
    words = clean[0][1].split()
    near = [(1000 + i, " ".join([*words, rng.choice(words)]), clean[0][2], "s", 0) for i in range(300)]
    same = [(2000 + i, *clean[1][1:]) for i in range(600)]
    rows = clean + near + same
    assert keep_identified(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)


def test_quality(spark, messy, empty, clashing):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 60).split()) if bad and i % 2 else (prose(rng, 2) + " ") * 40 if bad else prose(rng, 80)
        rows.append((i, text, None, None, 0))
        labels.append((i, int(not bad)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id bigint, quality int")
    allowed = F.col("doc_id") % 4 != 2
    got = {r.doc_id: r for r in classify(docs, train(docs, marks, allowed)).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert np.mean([got[i].predicted == (i % 5 != 0) for i in held]) > 0.95
    model = train(messy, marks, allowed)
    assert classify(messy, model).count() == messy.count() == classify(clashing, model).count()
    assert classify(empty, train(empty, marks, allowed)).count() == 0
    nothing = train(docs, marks.limit(0), allowed)
    assert nothing == (0.5, None) and classify(docs, nothing).first().score == 0.5
    assert not features(pa.array([None, ""], pa.string())).any()


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_prior_needs_no_negatives(spark, share):
    rng = random.Random(5)
    good = [rng.random() < share for _ in range(1500)]
    rows = [(i, prose(rng, 60) if g else " ".join(w + rng.choice(["###", "$$$"]) for w in prose(rng, 60).split()), None, None, 0) for i, g in enumerate(good)]
    docs = spark.createDataFrame(rows, SCHEMA)
    shown = [(i, int(g)) for i, g in enumerate(good) if g and i % 2 or not g and i % 50 == 0]  # most negatives hidden
    prior, model = train(docs, spark.createDataFrame(shown, "doc_id bigint, quality int"), F.lit(True))
    assert prior == pytest.approx(sum(good) / len(good), abs=0.08)
    wrong = sum(r.predicted != good[r.doc_id] for r in classify(docs, (prior, model)).collect())
    assert wrong < 30


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, k, f"s{i % 4}", len(t)) for i, t, k, *_ in language_rows(120)]
    rows += [(500 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(10)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "mixing", "packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")], name
    assert not {r.doc_id for r in docs.collect()} & set(range(500, 510))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and sum(r.length for r in out if r.start == 0) > 0
