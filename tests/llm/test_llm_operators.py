"""The corpus operators against brute force on small tables, and on awkward rows."""

from __future__ import annotations

import collections
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pageledger.llm import decontamination, hpylm, licences, near, packing, passages, quality_rules, token_files, tokens, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string"


def words(text):
    return WORD.findall((text or "").translate(A_Z))


def prose(rnd, n, size=2000):
    return " ".join(f"w{rnd.randrange(size)}" for _ in range(n))


AWKWARD = [
    (1, "one two three four five six", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (1, "one two three four five six", "a"), (None, "no id here at all", "c"),
    (5, "x" * 200_000, "a"), (6, "long " * 30_000, "a"), (7, "Ünïcode ñ 中文    <|endoftext|> end", "a"), (8, "one two three four five six", "a"), (-9, "tab\tand\rreturn\x0bmore", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns that operators use for themselves."""
    df = spark.createDataFrame(AWKWARD, DOCS)
    for name in ("_text", "_words", "n_words", "kept", "id", "digest", "h", "pos", "component_id", "bucket", "_cuts", "_row", "_order", "start", "a", "b", "shard", "chunk", "data", "item_id", "_stay"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "licences": licences.licence_scan,
    "near": near.near_classes,
    "quality": quality_rules.judged,
    "passed": quality_rules.passed,
    "packing": packing.packed,
    "tokens": lambda d: tokens.token_counts(d, BYTE),
    "ids": lambda d: token_files.read_ids(token_files.write_ids(d, WORDS, 2)),
    "model": hpylm.scores,
    "passages": lambda d: passages.with_components(passages.repeated_passages(d)),
    "cut": lambda d: passages.without_passages(d, passages.repeated_passages(d)),
    "template": lambda d: decontamination.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}
PER_ROW = ("licences", "near", "quality", "packing", "tokens", "ids", "model", "cut")


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(awkward, name):
    rows = OPERATORS[name](awkward).collect()
    if name in PER_ROW:
        assert collections.Counter(r.doc_id for r in rows) == collections.Counter(r[0] for r in AWKWARD)


def test_awkward_near_and_quality(awkward):
    got = {r.doc_id: r for r in near.near_classes(awkward, n=3, percent=85).collect()}
    assert [got[k].component_id for k in (1, 8, 2, 3, 4, None)] == [1, 1, 2, 3, 4, None]
    assert [got[k].n_shingles for k in (2, 3, 4, 5)] == [0, 0, 0, 1]
    judged = {r.doc_id: r for r in quality_rules.judged(awkward).collect()}
    assert judged[2].n_words == judged[4].n_words == 0 and judged[2].base_failed and judged[6].n_repeat_words == 30_000
    assert quality_rules.passed(awkward).columns == awkward.columns


def test_warc_round_trip_and_damage(spark, tmp_path):
    rows = [(1, "http://a b", "x" * 2000), (2, None, "x" * 2000), (3, "u", "x" * 2000), (4, "u", None), (5, "u", ""), (6, "u", "é" * 400), (None, None, None), (8, "http://z", "a\r\n\r\nWARC/1.0\r\n" * 100), (9, "http://z", "y" * 400_000)]
    got = {r.page_id: r for r in warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for key, _, html in rows:
        body = (html or "").encode()
        assert (got[key].payload_bytes, got[key].payload_digest) == (len(body), warc.hashlib.sha1(body).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3)}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(empty).collect() == []
    good = warc.arc_head("f", 1) + warc.arc_record(1, "http://a", "20010203", "text/html", 200, b"HTTP/1.0 200 OK\r\n\r\nbody", 0, "f")
    kinds = [r[7] for r in warc.parse_arc(good + b"http://b 0.0.0.0 2001 text/html 999\nshort", "f", "x")]
    assert kinds == ["warcinfo", "response", "damaged"]
    assert next(itertools.islice(warc.parse_arc(good, "f", "x"), 1, None))[4] == "2001-02-03T00:00:00Z"


def test_licence_expressions():
    value = lambda s: licences.evaluate(licences.expression_tokens(s))
    assert value("MIT OR GPL-3.0") == ({"mit", "gpl"}, 0.9)
    assert value("MIT AND GPL-3.0 */ more text") == ({"mit", "gpl"}, 0.4)
    assert value("(MIT OR Apache-2.0) AND CC-BY-NC-4.0") == ({"mit", "apache-2", "cc-by-nc"}, 0.2)
    assert value("GPL-2.0 WITH Classpath-exception-2.0") == ({"gpl"}, 0.7)
    assert value("AND MIT") == (set(), 0.0)
    assert licences.scan("// SPDX-License-Identifier: MIT OR GPL-2.0\nUnder the MIT License, under the mit license", licences.automaton())[:6] == (16, 2, 8, 12, "mit", "gpl,mit")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\r", "\t", "\xa0", "1", "é", "'s", "<|endoftext|>", "!", "　", "中", "\x1c", "|", "\x01", "\0", "ͅ", "Σ"]), max_size=14).map("".join))
def test_token_counts_and_ids_equal_the_library(text):
    counter, encoder = tokens.TokenCounter(BYTE, {}), token_files.worker_encoder(WORDS, 2)
    assert counter.many([text])[0] == len(tokens.tokenizer(BYTE).encode(text, add_special_tokens=False).ids)
    ids, n = encoder.many(token_files.pa.array([text, ""], token_files.pa.large_string()))
    want = tokens.tokenizer(WORDS).encode(text, add_special_tokens=False).ids
    assert ids.tolist() == [*want, 2, 2] and n.tolist() == [len(want) + 1, 1]


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 62, 5000, replace=False).astype(np.uint64)
    levels = token_files.build_hash(keys)
    assert sorted(token_files.slots_of(keys, levels)) == list(range(5000))


def test_token_files_with_repeated_and_missing_keys(spark):
    rows = [(3, "a b", ""), (1, None, ""), (3, "c d e", ""), (None, "x", ""), (2, "Hello, WORLD", "")]
    got = token_files.read_ids(token_files.write_ids(spark.createDataFrame(rows, DOCS), WORDS, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 3] and [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got[:-1])]
    ids = tokens.tokenizer(WORDS).encode("Hello, WORLD", add_special_tokens=False).ids + [2]
    assert got[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def components_of(sets, percent):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near_classes_equal_brute_force(spark, n, percent):
    rnd, rows = random.Random(n), []
    for g in range(25):
        base = prose(rnd, rnd.randint(30, 200), 300).split()
        for _ in range(rnd.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(int(len(base) * rnd.choice([0, 0, 0.01, 0.03, 0.06, 0.1]))):
                copy[rnd.randrange(len(copy))] = f"z{rnd.randrange(9999)}"
            rows.append((len(rows) * 7 % 1009, " ".join(copy), ""))
    sets = {}
    for key, text, _ in rows:
        w = words(text)
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    got = near.near_classes(spark.createDataFrame(rows, DOCS), n=n, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(sets, percent)
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(s) for k, s in sets.items()}


def test_near_hot_group_around_the_threshold(spark):
    """Hundreds of copies of one text, most pairs of them just below the threshold: no link is lost, and few pairs are compared."""
    rnd, n, percent, sets, rows = random.Random(9), 3, 85, {}, []
    base = prose(rnd, 120, 5000).split()
    for key in range(400):
        copy = list(base)
        for _ in range(rnd.randint(1, 6)):  # words of a small store, so that copies share some edits
            copy[rnd.randrange(len(copy))] = f"z{rnd.randrange(4)}"
        rows.append((key, " ".join(copy), ""))
        sets[key] = {tuple(copy[i : i + n]) for i in range(len(copy) - n + 1)}
    docs = spark.createDataFrame(rows, DOCS)
    got = near.near_classes(docs, n=n, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(sets, percent)


def test_prefix_pairs_lose_no_pair(spark):
    rnd, percent, sets = random.Random(4), 80, {}
    for key in range(150):
        of = sets[rnd.randrange(key)] if key % 3 else set()
        kept = {x for x in of if rnd.random() > rnd.choice([0, 0.05, 0.1, 0.2])}
        sets[key] = kept | {rnd.getrandbits(40) for _ in range(rnd.choice([0, 1, 2, 8]) + (0 if kept else rnd.choice([1, 2, 5, 30, 90])))}
    component = {k: k // 2 for k in sets}
    rows = [(k, 0, component[k], len(s), x) for k, s in sets.items() for x in s]
    pairs = near.prefix_pairs(spark.createDataFrame(rows, "id long, part long, component long, n long, shingle long"), percent).collect()
    linked = {(a, b) for a in sets for b in sets if a > b and component[a] != component[b] and (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b])}
    assert linked and linked <= {(r.a, r.b) for r in pairs} and len(pairs) == len(set(pairs))


def test_near_rows_of_one_document_with_different_texts(spark):
    rnd = random.Random(8)
    a, b, c, d = (prose(rnd, 60) for _ in range(4))
    rows = [(1, a, ""), (1, b, ""), (2, a + " more", ""), (3, b + " more", ""), (5, c, ""), (4, c, ""), (5, d, ""), (6, d, ""), (7, d + " more", ""), (8, prose(rnd, 60), "")]
    got = near.near_classes(spark.createDataFrame(rows, DOCS), n=3, percent=85).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1, (5, 4): 2, (6, 4): 1, (7, 4): 1, (8, 8): 1}


def test_repeated_passages(spark):
    rnd, rows, where = random.Random(3), [], collections.defaultdict(list)
    shared = [prose(rnd, k).split() for k in (51, 60, 120, 300)]
    for i in range(80):
        w = prose(rnd, rnd.randint(20, 300)).split()
        if i % 2:
            s = rnd.randrange(len(shared))
            at = rnd.randint(0, len(w))
            w[at:at] = shared[s]
            where[s].append((i, at))
        rows.append((i, " ".join(w).replace("w1 ", "W1\n"), ""))
    df = spark.createDataFrame(rows, DOCS)
    found = passages.repeated_passages(df)
    got = {(r.doc_id, r.component_id): r for r in passages.with_components(found).collect()}
    want = {(i, at, at + len(shared[s])) for s, hits in where.items() for i, at in sorted(hits)[1:]}
    assert {r.doc_id for r in got.values()} == {i for i, _, _ in want}
    for i, a, b in want:
        r = next(r for r in got.values() if r.doc_id == i)
        assert a - 3 <= r.start_word <= a and b <= r.end_word <= b + 3  # a neighbour may agree by chance
    assert len({c for _, c in got}) == len(where)
    left = {r.doc_id: len(r.text.split()) for r in passages.without_passages(df, found).collect()}
    for s, hits in where.items():
        assert left[min(hits)[0]] == len(rows[min(hits)[0]][1].split())


def test_stock_lines_are_no_passage(spark):
    rnd = random.Random(10)
    lines = [prose(rnd, 45, 10**6) for _ in range(8)]
    rows = [(i, " ".join([prose(rnd, 60, 10**6), t, prose(rnd, 60, 10**6)]), "") for i, t in enumerate(lines)] + [(50, " ".join(lines), "")]
    assert passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect() == []


def test_passage_made_of_earlier_phrases(spark):
    rnd = random.Random(11)
    passage = prose(rnd, 60, 10**6).split()
    # every run of five words of the passage stands earlier in a short phrase
    rows = [(i, " ".join([prose(rnd, 60, 10**6), *passage[at : at + 8], prose(rnd, 60, 10**6)]), "") for i, at in enumerate(range(0, 56, 4))]
    rows += [(i, " ".join([prose(rnd, 70, 10**6), *passage, prose(rnd, 70, 10**6)]), "") for i in (100, 101, 102)]
    got = passages.with_components(passages.repeated_passages(spark.createDataFrame(rows, DOCS))).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.kept_doc_id, r.component_doc_id) for r in got} == {(i, 70, 130, 100, 100) for i in (101, 102)}


def test_templates(spark):
    bench = spark.createDataFrame([(1, "A train leaves the station with 12 passengers and Maria pays 30 dollars for 12 tickets to the old town."), (2, "short item"), (None, "x"), (3, None)], "item_id long, text string")
    rows = [
        (1, "words before. A train leaves the station with 15 passengers and Johann pays 40 dollars for 15 tickets to the old town. Then", ""),
        (2, "A train leaves the station with 15 passengers and Johann pays 40 dollars for 16 tickets to the old town.", ""),  # one value becomes two
        (3, "nothing of that kind, short item", ""), (4, None, ""), (5, "A train leaves the station with 12 passengers and Maria pays 30 dollars for 12 tickets to the old town.", ""),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.item_id, r.verbatim) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: (1, False), 5: (1, True)}
    assert {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()} == {2, 3, 4}


def test_edited_templates(spark):
    item = "yesterday the old baker sold 12 loaves of rye bread to a tall sailor who paid with 3 silver coins and then asked for 12 more loaves because his hungry crew was waiting at the pier near town"
    w = item.split()
    bad = item.replace("12 loaves", "15 loaves").replace("12 more", "16 more").replace("rye", "oat").replace("silver", "golden")
    rows = [
        " ".join([*w[:19], "rather", *w[19:]]),  # a word put in
        item.replace("3 silver", "30 000 silver"),  # two words for one
        item.replace("baker", "miller").replace("paid", "came").replace("hungry", "thirsty"),  # changed words
        " ".join(w[:20]),  # a long run alone
        f"{bad} {item}",  # an inconsistent copy, then the item
        bad,
    ]
    docs = spark.createDataFrame([(i, f"some words before it. {t} and some after", "") for i, t in enumerate(rows)], DOCS)
    got = [r.doc_id for r in decontamination.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert sorted(got) == [0, 1, 2, 3, 4]


def test_items_without_a_window(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet first?"), (2, "1 2 3 5 8 13 21 34 55 89 144"), (3, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "we ask: Who wrote Hamlet first? Nobody", ""), (2, "go 1 2 3 5 8 13 21 34 55 89 144 on", ""), (3, "1 2 3 5 8 13 21 34 55 90 and who wrote Hamlet, two words", "")], DOCS)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(1, 1), (2, 2)]


def test_best_boundaries_equal_brute_force():
    rnd = np.random.default_rng(2)
    for _ in range(30):
        n, k = int(rnd.integers(1, 9)), int(rnd.integers(1, 5))
        sizes, counts = np.sort(rnd.choice(50, n, replace=False)) + 1, rnd.integers(1, 20, n)
        cost = lambda ends: sum(c * (min(e for e in ends if e >= s) - s) for s, c in zip(sizes, counts))  # noqa: B023, E731
        best = min(cost([*some, sizes[-1]]) for r in range(min(k, n)) for some in itertools.combinations(sizes[:-1], r))
        assert cost(packing.best_boundaries(sizes, counts, k)) == best


def test_best_boundaries_of_many_long_lengths():
    """Lengths far above a thousand keep their own bins: the padding is that of a plain dynamic program over all of them."""
    rnd = np.random.default_rng(3)
    sizes = np.sort(rnd.choice(2_000_000, 400, replace=False)) + 1
    counts = rnd.integers(1, 1000, 400)
    padding = lambda i, j: int((counts[i:j] * (sizes[j - 1] - sizes[i:j])).sum())
    best = [0, *[padding(0, j) for j in range(1, 401)]]
    for _ in range(4):
        best = [0, *[min(best[i] + padding(i, j) for i in range(j)) for j in range(1, 401)]]
    ends = packing.best_boundaries(sizes.tolist(), counts.tolist(), 5)
    places = np.searchsorted(ends, sizes)
    assert len(ends) == 5 and int((counts * (np.array(ends)[places] - sizes)).sum()) == best[400]


def test_packing_pads_to_lengths_that_occur(spark):
    docs = spark.createDataFrame([(i, "w " * k, "") for i, k in enumerate([1500, 1501, 1501, 5003, 5003, 9000])], DOCS)
    assert sorted(r.padded_length for r in packing.packed(docs, buckets=3).collect()) == [1502, 1502, 1502, 5004, 5004, 9001]


def test_packing_batches(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rnd, rnd.choice([3, 40, 700, 3000]) + rnd.randrange(30)), "") for i in range(300)], DOCS)
    rows = packing.packed(docs, buckets=4, token_budget=4096).collect()
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.padded_length
        batches[r.bucket, r.batch_id].append(r)
    assert len(rows) == 300 and all(len(b) == 1 or len(b) * b[0].padded_length <= 4096 for b in batches.values())
    assert all(sorted(r.slot for r in b) == list(range(len(b))) for b in batches.values())


def test_quality_order_does_not_change_the_verdict(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice([prose(rnd, 80), "a b c " * 40, "### *** " * 40, prose(rnd, 10), prose(rnd, 90).upper(), "same line\n" * 60]), "") for i in range(60)]
    docs, rules = spark.createDataFrame(rows, DOCS), quality_rules.rules()
    features = quality_rules.with_features(docs)
    kept = [{r.doc_id for r in features.where(quality_rules.cascade(o).isNull()).collect()} for o in (rules, rules[::-1])]
    assert kept[0] == kept[1] == {r.doc_id for r in quality_rules.passed(docs).collect()} == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}


def test_drawn_tables_follow_their_distribution():
    d, weight, c = 0.6, 0.8, 6
    stirling = hpylm.log_stirling(d)
    p = np.exp(stirling[c, 1 : c + 1] + np.arange(1, c + 1) * math.log(weight))
    draws = hpylm.draw_tables(np.full(40_000, c), np.full(40_000, weight), d, np.random.default_rng(1))
    assert np.allclose(np.bincount(draws, minlength=c + 1)[1:] / 40_000, p / p.sum(), atol=0.015)
    many = hpylm.draw_tables(np.full(200, 5_000), np.full(200, 2.0), d, np.random.default_rng(2))
    assert many.min() >= 1 and many.max() < 5_000


def test_language_model(spark):
    rnd = random.Random(7)
    pairs = {f"w{i}": f"w{(i * 7 + 3) % 40}" for i in range(40)}
    rows = []
    for i in range(400):
        w = [f"w{rnd.randrange(40)}"]
        while len(w) < 60:
            w.append(pairs[w[-1]] if rnd.random() < 0.7 else f"w{rnd.randrange(40)}")
        rows.append((i, " ".join(w), ""))
    got = {r.doc_id: r for r in hpylm.scores(spark.createDataFrame(rows, DOCS), share=0.001).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 1]
    assert {i for i, r in got.items() if r.held_out} == set(out)
    count = collections.Counter(x for k, t, _ in rows if k not in set(out) for x in [*words(t), None])
    total = sum(count.values())
    for key, text, _ in rows:
        w = [*words(text), None]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (len(count) + 1))) for x in w)
        r = got[key]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), total) and abs(r.base_score - base) < 1e-6 * abs(base)
    # held-out accuracy: the model knows the pairs, the base does not
    n = sum(got[i].n_tokens for i in out)
    assert 10 ** (-sum(got[i].score for i in out) / n) < 0.5 * 10 ** (-sum(got[i].base_score for i in out) / n)


def test_every_context_has_a_restaurant(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for i in range(400):
        w = [rnd.randrange(200)]
        while len(w) < 60:
            w.append((w[-1] * 7 + 3) % 200 if rnd.random() < 0.8 else rnd.randrange(200))
        rows.append((i, " ".join(f"w{x}" for x in w), ""))
    monkeypatch.setattr(hpylm, "BUCKET_BYTES", 20_000)  # several buckets
    df, bits = spark.createDataFrame(rows, DOCS), {}
    for share in (0.0001, 0.01, 1):  # all words frequent, the end token only, none
        out = [r for r in hpylm.scores(df, share=share).collect() if r.held_out]
        bits[share] = [-sum(getattr(r, c) for r in out) / sum(r.n_tokens for r in out) for c in ("score", "base_score")]
    assert all(score < 0.6 * base and abs(score - bits[0.0001][0]) < 0.01 * score for score, base in bits.values())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(8)
    item = prose(rnd, 40)
    passage = prose(rnd, 80)
    texts = [prose(rnd, 150) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    add = lambda t: rows.append((len(rows), t, "en", "s", None if t is None else len(t)))
    add(texts[0]), add(" ".join(texts[1].split()[:-1])), add("a b " * 50), add(None), add(prose(rnd, 60) + " " + passage), add(passage + " " + prose(rnd, 60)), add(prose(rnd, 60) + " " + item)
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.materialize(out)
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == set(range(12)) | {12, 13, 16, 17, 18}
    assert set(kept[1]) == set(range(12)) | {16, 17, 18}
    assert set(kept[2]) == set(kept[1]) and len(kept[2][17].text.split()) == 60 and kept[2][17].n_chars == len(kept[2][17].text) and kept[2][16].text == rows[16][1]
    assert set(kept[3]) == set(range(12)) | {16, 17}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(kept[3])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert json.dumps(sorted(entry.oracle_sql()))
