"""Licence rules, ranked search and the filter audit on small tables, against plain versions."""

import random
import re
from collections import Counter
from itertools import permutations
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import search as engine
from factloom.llm.license_rules import PHRASES, RULES
from factloom.llm.licenses import licence_scan, licence_spans
from factloom.llm.search import Search, best_of_shard, packed, search, unpacked
from factloom.llm.survival import filter_audit, positional_popcount

CLASH = ("row", "label", "level", "rule", "kept", "words", "hits", "part", "k1", "failed", "good", "shard", "term", "rank", "score")


def labels_of(spark, text):
    return licence_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: MIT-0", "mit-0"),
    ("GNU General Public License, version 3 or later", "gpl,gpl-3.0-or-later"),
    ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("CC BY-NC-ND 4.0", "cc-by,cc-by-nc-nd"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("an apache and its licence are no statement", ""),
    ("Mozilla Public License 2.0, or the Boost Software License 1.0", "bsl-1.0,mpl-2.0"),
    ("BSD 2-Clause License", "bsd-2-clause"),
])
def test_statements(spark, text, labels):
    assert labels_of(spark, text).labels == labels


def test_rules_are_in_order():
    assert len(RULES) > 250 and [r.number for r in RULES] == list(range(len(RULES)))
    assert len({(r.keyword, r.label, r.pattern) for r in RULES}) == len(RULES)
    assert all(re.compile(r.pattern) and not re.search("[A-Z]", r.label + r.keyword) for r in RULES)


def plain_matches(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    blank = "".join(f" {w} " for w in words)
    rules = [(r.number, r.level, r.label, r.pattern) for r in RULES] + [
        (-1 - k, 0, label, phrase.replace(" ", "  ")) for k, (phrase, label) in enumerate(PHRASES.items())]
    out = []
    for number, level, label, pattern in rules:
        for m in re.finditer(f" (?:{pattern}) ", blank):
            a = blank[:m.start()].count(" ") // 2
            out.append((number, level, label, a, a + m[0].count(" ") // 2))
    kept = [x for x in out if x[1] == 0 or not any(
        y[1] >= x[1] and y[3] <= x[3] and y[4] >= x[4] and (y[3:] != x[3:] or y[1] > x[1] or y[0] < x[0]) for y in out)]
    return len(words), out, kept


def test_scan_equals_a_plain_version(spark, sf_dir):
    rng = random.Random(5)
    parts = ["Apache License, Version 2.0", "MIT License", "gnu GPL v3", "GNU General Public License version 2", "CC BY-SA 4.0", "cc by", "SPDX-License-Identifier: GPL-2.0-or-later",
             "creative commons attribution 4.0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "all rights reserved", "lorem ipsum", "ünicode",
             "BSD 3-Clause License", "in the public domain", "---", "mit", "license", "apache", "Mozilla Public License 2.0"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {}
    for r in licence_spans(df).collect():
        spans.setdefault(r.doc_id, []).append((r.rule, r.level, r.label, r.start, r.end, r.kept))
    for r in licence_scan(df).collect():
        n, every, kept = plain_matches(texts[r.doc_id])
        assert sorted(spans.get(r.doc_id, [])) == sorted((*x, x in kept) for x in every)
        starts = [x[3] for x in kept if x[1] == 0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(starts), min(starts, default=None), max(starts, default=None))
        assert r.labels == ",".join(sorted({x[2] for x in kept})) and 0 <= r.score <= 1
        assert r.base_labels == ",".join(sorted({x[2] for x in kept if x[1] == 0}))


def test_licences_of_a_very_long_text(spark):
    text = "the MIT License and Apache License 2.0 " * 20_000
    r = labels_of(spark, text)
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (160_000, 40_000, 1, 159_996) and r.labels == "apache,apache-2.0,mit"


def plain_search(docs, items, top=10):
    def terms(text):
        return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counted = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = Counter(t for i, text in items if i == item for t in terms(text))
        scored = []
        for (d, c), n in zip(counted, sizes):
            m = 25 + (75 * n * n_docs) // n_terms if n_terms else 0
            s = sum(k * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("p", [Search(), Search(block=4, window=16, shard_postings=300, merges=2), Search(block=2, window=3, shard_postings=40, query_terms=5)])
def test_search_equals_a_plain_version(spark, p):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["Ä", "x1"]
    pick = [rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 40)) for _ in range(160)]
    docs = [(k, " ".join(w).upper() if k % 3 else "-".join(w)) for k, w in enumerate(pick)]
    docs += [(500 + k, docs[7][1]) for k in range(40)] + [(900, None), (901, ""), (902, " ?! "), (None, docs[9][1]), (5, "w50 w51"), (5, "w50 w51"), (903, "w3 " * 5000)]
    items = [(1, "w1 w40 w59 w2"), (2, "w50 w50 x1"), (2, "ä"), (3, None), (4, ""), (None, "w30 w31 w31"), (6, "nowhere"), (7, docs[7][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in CLASH})
    assert sorted((tuple(r) for r in search(df, bench, params=p).collect()), key=repr) == plain_search(docs, items)
    assert search(df.limit(0), bench, params=p).count() == 0 and search(df, bench.limit(0), params=p).count() == 0


def test_blocks_are_rejected_unopened(monkeypatch):
    """Once ten good documents are known, blocks of a common term that cannot help stay packed."""
    from factloom.llm.search import Postings, Shard
    rng, shard, opened = random.Random(2), Shard(), []
    for k in range(6000):
        rare = [b"rare"] * 3 if k < 12 or k == 5000 else []
        shard.add(k, [b"common"] * rng.randrange(1, 4) + rare + [b"pad"] * rng.randrange(5, 30))
    rows = {}
    for batch in shard.rows(0, 128):
        for r in batch.to_pylist():
            rows.setdefault(r["term"], []).append(r)
    about = rows.pop(None)[0]
    lengths = np.array(about["lengths"])
    n_docs, n_terms = len(lengths), int(lengths.sum())
    factors = engine.length_factor(lengths, n_docs, n_terms)
    real = Postings.block
    monkeypatch.setattr(Postings, "block", lambda self, k: (opened.append((self.bound, k)), real(self, k))[1])
    lists = [(w, Postings(rows[t], factors, n_docs, n_terms)) for t, w in (("rare", 6000), ("common", 10))]
    scores, docs = best_of_shard(lists, np.array(about["doc_ids"]), Search(window=512))
    whole = np.zeros(n_docs, np.int64)
    for w, q in lists:
        for k in range(len(q.last)):
            d, g = real(q, k)
            whole[d] += w * g
    want = np.lexsort((np.arange(n_docs), -whole))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()
    common = lists[1][1]
    assert len({k for b, k in opened if b == common.bound}) < len(common.last) / 2


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31 - 1], np.int64)
    data, sizes = packed(values)
    assert unpacked(data.tobytes()).tolist() == values.tolist() and sizes.sum() == len(data)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 31, 1000, 4097])
def test_carry_save_counts(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert positional_popcount(words).tolist() == [int((words >> np.uint32(k) & 1).sum()) for k in range(32)]


def plain_audit(docs, labels):
    def fails(d, t, first):
        w = re.findall("[^\x20\x09-\x0D]+", t)
        return {x for x, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)),
            d is not None and first.get(t, d) < d)) if bad}

    first = {}
    for d, _, t in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = [(p or "", fails(d, t or "", first), any(x == d is not None and q == 1 for x, q, _ in labels), any(x == d is not None and q == 1 for x, _, q in labels)) for d, p, t in docs]
    out, total = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                total[part, x] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(x in r[1] for r in own) - len(gone),
                            sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted(tuple([*r, total[r[0], r[1][r[2] - 1]]]) for r in out)


def test_audit_equals_a_plain_version(spark):
    rng = random.Random(1)
    docs = []
    for k in range(120):
        words = [rng.choice(["Ab", "cd", "E#", "fgh", f"u{rng.randrange(400)}"] if k % 2 else [f"v{rng.randrange(900)}"]) for _ in range(rng.choice([3, 99, 100, 140]))]
        docs.append((k, rng.choice(["en", "de", None, ""]), " ".join(words)))
    docs += [(200 + k, "en", docs[3][2]) for k in range(5)] + [(300, "fr", None), (301, "fr", ""), (None, "fr", ""), (None, None, docs[3][2]), (40, "de", docs[40][2]), (302, "x", "y " * 30_000)]
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 110)] + [(2, None, 1), (2, 1, None), (None, 1, 1), (300, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in CLASH})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    want = plain_audit(docs, labels)
    assert sorted(tuple(r) for r in filter_audit(df.repartition(5), marks).collect()) == want
    assert filter_audit(df.limit(0), marks).count() == 0
    assert all(r.good_lost == r.toxic_lost == 0 for r in filter_audit(df, marks.limit(0)).collect())
