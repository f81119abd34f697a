"""Every query of the package against its oracle or a plain version."""

import hashlib
import re
import sys

import duckdb
import pytest

from factloom import llm
from factloom.llm.catalog import piece_model

sys.path.insert(0, "tools")
from verify import TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    df = llm.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(llm.ORACLES[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_all_queries_are_named():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in llm.QUERIES) == list(range(1, 14))


def test_pieces_equal_the_library(spark, sf_dir, duck):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in llm.QUERIES["op8_sentencepiece"](spark, sf_dir).collect():
        ids = model.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def plain_coverage(item, doc, least):
    """Greedy string tiling by comparing every pair of positions."""
    mark_i, mark_d, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]
                       and i + n not in mark_i and j + n not in mark_d):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        mark_i.update(range(i, i + n))
        mark_d.update(range(j, j + n))
        covered += n


def test_tilings_equal_a_plain_version():
    import numpy as np

    from factloom.llm.tiling import tiles
    rng = np.random.default_rng(4)
    for letters in (2, 3, 6, 40):
        for _ in range(25):
            item = rng.integers(0, letters, rng.integers(5, 30)).astype(np.uint64)
            doc = np.concatenate([rng.integers(0, letters, 12).astype(np.uint64), *(
                item[a:a + 9] for a in rng.integers(0, len(item), 3))])
            found = tiles(item, doc, 3)
            for i, j, n in found:
                assert n >= 3 and (item[i:i + n] == doc[j:j + n]).all()
            spans = sorted((i, i + n) for i, _, n in found)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
            longest = max((n for _, _, n in found), default=0)
            whole = plain_coverage(item.tolist(), doc.tolist(), 3)
            if letters >= 6:  # with few letters ties may be broken another way
                assert abs(sum(n for _, _, n in found) - whole) <= 3
            assert (longest >= 3) == (whole > 0)


def test_reordered_passages_are_caught(spark):
    from factloom.llm.tiling import Leaks, decontaminate
    item = " ".join(f"w{k}" for k in range(40))
    words = item.split()
    moved = " ".join(words[20:40] + ["other"] * 30 + words[0:20])
    half = " ".join(words[:22] + ["x"] * 9)
    few = " ".join(words[:12] + ["y"] * 9)
    docs = spark.createDataFrame([(1, moved), (2, half.upper()), (3, few), (4, ", ".join(words))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "too short")], "item_id long, text string")
    for p in (Leaks(), Leaks(seeds=1), Leaks(broadcast_rows=0)):
        got = {r.doc_id: (r.contaminated, r.item_id, round(r.coverage, 3)) for r in decontaminate(docs, bench, params=p).collect()}
        assert got == {1: (True, 7, 1.0), 2: (True, 7, 0.55), 3: (False, None, 0.0), 4: (True, 7, 1.0)}


def test_toxicity_on_rows_it_has_not_seen(spark):
    import random

    from factloom.llm.toxicity import toxicity
    rng = random.Random(3)
    words = [f"wort{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(3000):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            text += [rng.choice(["idiot", "scum", "grobix", "grobul", "snarfen"]) + rng.choice(["", "", "an"]) for _ in range(3)]
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out]
    assert 400 < len(held) < 800
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_toxicity_on_held_out_labels(spark):
    """Precision and recall on labelled rows that no label was learned from."""
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = llm.QUERIES["op2_weak_toxicity"](spark, sf_dir).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    both = sum(r.predicted and r.toxic for r in rows)
    assert len(rows) > 500
    assert both / sum(r.predicted for r in rows) > 0.9 and both / sum(r.toxic for r in rows) > 0.75


def test_label_model_finds_accuracies_and_correlations():
    import numpy as np

    from factloom.llm.toxicity import LabelModel
    rng = np.random.default_rng(1)
    y = rng.random(40_000) < 0.1
    a, b = (rng.random(len(y)) < np.where(y, 0.8, 0.01) for _ in range(2))
    c = rng.random(len(y)) < np.where(y, 0.6, 0.02)
    d = np.where(rng.random(len(y)) < 0.8, c, rng.random(len(y)) < 0.05)  # mostly repeats c
    pattern = a + 2 * b + 4 * c + 8 * d.astype(int)
    values, counts = np.unique(pattern, return_counts=True)
    model = LabelModel(values, counts, 4, 0.05)
    assert (model.parent[2] == 3) or (model.parent[3] == 2)
    share = (counts * model.posterior).sum() / counts.sum()
    assert 0.07 < share < 0.14
    for k, votes in enumerate((a, b, c)):
        assert abs(model.accuracies[k] - (votes == y).mean()) < 0.05
