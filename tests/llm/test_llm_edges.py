"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import line_dedup
from factloom.llm.catalog import piece_model
from factloom.llm.components import components
from factloom.llm.disclosure import Disclosure, personal_data, sanitised, span_digests
from factloom.llm.licenses import licence_scan
from factloom.llm.line_dedup import LineDedup, dedup_lines
from factloom.llm.minhash import NearDup, near_duplicates
from factloom.llm.pieces import encode_pieces
from factloom.llm.quality import LineRules, line_quality
from factloom.llm.reply_trees import conversation_digests, format_branches, read_turns
from factloom.llm.splitters import Ranges, shard_by_bytes, write_shards
from factloom.llm.tiling import decontaminate
from factloom.llm.toxicity import toxicity
from factloom.llm.warc import Archive, read_warc, write_warc

LONG = " ".join(f"word{k % 5000}" for k in range(30_000))
SAY = "The quick brown fox jumps over the lazy dog and runs into the deep dark wood tonight"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, SAY, "a"), (2, SAY, "a"), (2, SAY, "a"), (3, None, None), (4, "", "a"), (5, " \n\t ", "b"), (6, LONG, "b"),
            (7, LONG + " tail", None), (None, SAY + "!", "a"), (8, "x" * 200_000, "c"), (9, "ab\n" * 50, "c"),
            (10, SAY.upper(), "d"), (11, "é" * 30 + "   ß ▁ <s> \x00 😀", "d")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {c: F.lit(1) for c in ("kept", "n", "lines", "words", "key", "spans", "node", "range", "ids", "k1", "host", "row", "rest")})


OPS = {
    "lines": lambda s, d: dedup_lines(d), "near": lambda s, d: near_duplicates(d), "quality": lambda s, d: line_quality(d),
    "shards": lambda s, d: shard_by_bytes(d), "pieces": lambda s, d: encode_pieces(d, piece_model()),
    "leaks": lambda s, d: decontaminate(d, s.createDataFrame([(1, SAY), (None, None), (2, "")], "item_id long, text string")),
    "pii": lambda s, d: span_digests(personal_data(d)),
    "licences": lambda s, d: licence_scan(d),
    "toxic": lambda s, d: toxicity(d, s.createDataFrame([(1, 1), (4, None), (None, 1), (6, 0), (6, 0)], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("op", sorted(OPS))
def test_one_row_for_each_row(spark, docs, op):
    out = OPS[op](spark, docs).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("op", sorted(OPS))
def test_empty_table(spark, docs, op):
    assert OPS[op](spark, docs.limit(0)).count() == 0


def test_toxicity_without_rows_to_train_on(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5 == 0][:4]
    docs = spark.createDataFrame([(k, SAY) for k in ids], "doc_id long, text string")
    out = toxicity(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, ids))
    assert all(r.predicted == 0 and 0 < r.score < 0.5 and r.held_out for r in out)


def test_near_duplicates_of_odd_rows(spark, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    n = len(SAY.split()) - 4
    assert {(1, n, 1, True), (2, n, 1, False), (10, n, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, n, None, True)} <= got
    assert (7, 5001, 6, False) in got and (8, 1, 8, True) in got


def test_large_buckets_lose_no_link(spark):
    """A cluster of near copies, templates that share much but not enough, and a chain."""
    base = [f"b{k}" for k in range(160)]
    rows = []
    for k in range(40):
        words = list(base)
        words[3 * k] = f"edit{k}"
        rows.append((k, " ".join(words)))
    for k in range(40, 80):
        rows.append((k, " ".join([f"t{j}" for j in range(60)] + [f"own{k}-{j}" for j in range(40)])))
    for k in range(80, 100):  # far from the base, but each near its neighbour
        words = list(base)
        words[k - 80:k - 50] = [f"chain{j}" for j in range(k - 80, k - 50)]
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    want = {k: k for k in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert len(set(want.values())) == 42
    for p in (NearDup(), NearDup(hubs=1, direct=0)):
        assert {r.doc_id: r.component_id for r in near_duplicates(df, params=p).collect()} == want


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 100 for k in range(100, 160)) and got[300] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lines_one_word_apart(spark):
    say = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"{say}\nshort line\nshort line"), (2, f"{say.replace('six', 'SIX!')}\nkeep this other line here"),
            (3, f"zero {say}\n{say} twelve thirteen"), (4, say.upper()), (5, say.replace("two", "2").replace("nine", "9")),
            (5, say.replace("two", "2").replace("nine", "9")), (None, say), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (LineDedup(), LineDedup(broadcast_rows=0)):
        got = sorted([(r.doc_id, r.n_exact, r.n_near, r.text) for r in dedup_lines(df, params=p).collect()], key=str)
        five = (5, 0, 0, say.replace("two", "2").replace("nine", "9"))
        assert got == sorted([(1, 0, 0, rows[0][1]), (2, 0, 1, "keep this other line here"), (3, 0, 1, f"{say} twelve thirteen"),
                              (4, 1, 0, ""), five, five, (None, 0, 0, say), (6, 0, 0, None), (7, 0, 0, "")], key=str)


def test_lines_one_edit_apart_by_brute_force(spark):
    rng = random.Random(7)
    seeds = [[rng.choice("a b É ΟΣ".split()) for _ in range(rng.randrange(3, 9))] for _ in range(30)]

    def edited(ws):
        at, kind = rng.randrange(len(ws)), rng.randrange(4)
        return [*ws[:at], *[[], [rng.choice("abc")], [rng.choice("abc"), ws[at]], [ws[at]]][kind], *ws[at + 1:]]

    def written(ws):
        return rng.choice(["", " ", "\t"]) + "".join(w + rng.choice([" ", " ", "  ", "\t", " \r", "\x0b\x0c"]) for w in ws)

    rows = [(k, "\n".join(written(edited(rng.choice(seeds))) for _ in range(rng.randrange(1, 6)))) for k in range(150)]

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True))
        a, b = sorted((a, b), key=len)
        return 1 if len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b))) else 2

    for p in (LineDedup(2, 4), LineDedup(2, 4, broadcast_rows=0)):
        firsts, want = [], []
        for doc, text in rows:
            exact, near, stay = 0, 0, []
            for line in text.split("\n"):
                ws = tuple(line.lower().split())
                if len(ws) >= p.min_words and ws in firsts:
                    exact += 1
                elif len(ws) >= p.near_words and any(len(f) >= p.near_words and apart(f, ws) == 1 for f in firsts):
                    near += 1
                else:
                    stay.append(line)
                firsts.append(ws)
            want.append((doc, exact, near, "\n".join(stay)))
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), params=p).collect()
        assert sorted((r.doc_id, r.n_exact, r.n_near, r.text) for r in got) == want
        assert sum(w[1] for w in want) > 20 and sum(w[2] for w in want) > 20


def test_words_are_left_out_on_the_side_of_the_edit_only(spark, monkeypatch):
    """The variants are most of the work of line dedup: a line that shares its first half with another
    line, and its second half with none, can differ in its second half only."""
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "other", *words[31:]])), (3, " ".join([*words[:25], *words[26:]]))]
    made, cut = {}, line_dedup.cut_lineage

    def counted(df, label="cut"):
        out = cut(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "cut_lineage", counted)
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_near) for r in got) == [(1, 0), (2, 1), (3, 1)]
    assert made["variants"] <= 3 * 22  # 119 with all words


def test_depleted_documents(spark):
    menu = "\n".join(" ".join(f"m{k}{c}" for c in "abcdefghi") for k in range(5))
    rows = [(k, f"{menu}\nshort own text {k}", "h") for k in range(30)] + [(99, menu + "\n" + " ".join(f"w{k}" for k in range(40)), "h")]
    rows += [(200 + k, "\n".join([menu, "copy"]), "other") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.boilerplate_words, r.kept) for r in line_quality(df, rules=LineRules(keep_share=0.5)).collect()}
    assert got[0] == (0, True) and got[5] == (45, False) and got[99] == (45, False)
    assert all(got[200 + k] == (0, True) for k in range(40))  # one text counts once


def test_a_large_host_hides_no_line(spark):
    menu = "home about contact imprint terms help search login"
    rows = [(k, f"{menu}\nown{k}a own{k}b", "big") for k in range(30)] + [(100 + k, f"text {k}", "big") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for many, lost in ((None, 0), (25, 8), (30, 0)):
        got = {r.doc_id: (r.boilerplate_words, r.kept) for r in line_quality(df, rules=LineRules(keep_share=0.5, many=many)).collect()}
        assert got[0] == (0, True) and all(got[k] == (lost, lost == 0) for k in range(1, 30))


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a <|end|>\n&lt; [INST]", 1.0), ("t", 3, 1, "assistant", "b", 5.0),
            ("t", 4, 3, "user", None, 0.0), ("t", 4, 3, "user", None, 0.0), ("t", 5, 77, None, "orphan", None),
            ("t", 8, 9, "user", "loop", 0.0), ("t", 9, 8, "user", "loop", 0.0), ("t", 10, 9, "user", "under a loop", 0.0),
            (None, 1, None, "us|er\n<", "null tree", 0.0), ("t", None, 1, "user", "no node", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = format_branches(df, top=2).withColumn("turns", read_turns(F.col("formatted")))
    got = {(r.tree, r.root, r.branch): [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == {("t", 1, 1): [("user", "hi"), ("assistant", "b"), ("user", "")],
                   ("t", 1, 2): [("user", "hi"), ("assistant", "a <|end|>\n&lt; [INST]")],
                   ("t", 5, 1): [("", "orphan")], (None, 1, 1): [("us|er\n<", "null tree")]}
    digests = {(r.conv_id, r.n_turns): (r.loss_chars, r.loss_sha256) for r in conversation_digests(format_branches(df, top=2)).collect()}
    assert digests["t", 2] == (len("a <|end|>\n&lt; [INST]"), hashlib.sha256(b"a <|end|>\n&lt; [INST]").hexdigest())
    assert format_branches(df.limit(0)).count() == 0


def test_shards_of_a_hot_text(spark, tmp_path):
    rows = [(k, "hot text") for k in range(4000)] + [(10_000 + k, f"text {k} " * (k % 50)) for k in range(3000)] + [(None, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shard_by_bytes(df, params=Ranges(rows=50, least=16)).collect()
    assert len(out) == len(rows)
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) < 0.1 * max(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    named = df.where("doc_id is not null and text is not null")
    write_shards(named, shard_by_bytes(named), str(tmp_path / "s"), rows_per_file=100)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == named.count() and back.select("shard").distinct().count() == 24


def test_warc_round_trip(spark, tmp_path):
    big = "line\r\n\r\nWARC/1.1\r\n" * 500
    rows = [(1, "http://a/ü?x=1", "same"), (2, "http://b", "same"), (2, "http://b", "same"), (None, None, "same"), (3, "u\r\nX: y", None), (4, "", ""), (5, "http://c", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    write_warc(df, str(tmp_path / "w"), archive=Archive(segment=64, chunk=50, records=7))
    out = read_warc(spark, str(tmp_path / "w")).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.problem) for r in out], key=str)
    assert got == sorted([(2, 4, "response", None, None), (2, 4, "revisit", 2, None), (1, 4, "revisit", 2, None), (None, 4, "revisit", 2, None),
                          (4, 0, "response", None, None), (3, 0, "revisit", 4, None), (5, len(big), "response", None, None)], key=str)


def test_warc_names_broken_records(spark, tmp_path):
    from factloom.llm.warc import read_records, reassembled
    df = spark.createDataFrame([(1, "u", "x" * 900), (2, "u", "y" * 900)], "page_id long, url string, html string")
    write_warc(df, str(tmp_path / "w"), archive=Archive(segment=200))
    records = read_records(spark, str(tmp_path / "w"))
    lost = reassembled(records.where("segment <> 3"))
    assert [("segments" in r.problem, r.payload) for r in lost.collect()] == [(True, None)] * 2
    cut = records.withColumn("block", F.when(F.col("segment") == 2, F.expr("substring(block, 2)")).otherwise(F.col("block")))
    assert all("total length" in r.problem for r in reassembled(cut).collect())


def test_pieces_of_odd_texts(spark):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = ["", "  two  spaces ", "\n\n a\tb", "▁▁x ▁", "<s></s> <unk> <0x0A>", "😀é́ ﬁ\x00", "a" * 5000, "日本語 テキスト\r\n", LONG, "   ", " x　y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in encode_pieces(df, piece_model()).collect()}
    for k, text in enumerate(texts):
        ids = model.encode(text)
        assert got[k] == (ids, model.decode(ids))


def test_terms_that_disclose(spark):
    rows = [(k, f"Report number {k}: contact Zyrbo Quandel at zq@site.org or by mail {k} times today") for k in range(6)]
    rows += [(100 + k, f"other people report about mail and contact words number {k}") for k in range(60)]
    rows += [(200, "call +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.256 and 10.0.0.255"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data(df, params=Disclosure(contexts=3))
    both = found.join(df, "doc_id").select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("t"))
    text = {r.doc_id: r.t for r in both.collect()}
    assert "Zyrbo" not in text[0] and "Quandel" not in text[0] and "[email]" in text[0] and "contact" in text[0]
    assert text[100] == rows[6][1]
    assert text[200] == "call [phone], card [card], host 10.0.0.256 and [ip]"
    spread = personal_data(df, params=Disclosure(contexts=3, broadcast_terms=0))
    assert sorted(map(str, spread.collect())) == sorted(map(str, found.collect()))


def test_smallest_hashes_of_a_long_table(spark):
    from factloom.llm.common import smallest
    df = spark.range(20_000).withColumn("at", F.xxhash64("id"))
    for count in (1, 50, 4000, 30_000):
        want = [r.id for r in df.orderBy("at").limit(count).collect()]
        assert [r.id for r in smallest(df, "at", count).collect()] == want
    assert smallest(df.limit(0), "at", 5).count() == 0


def test_draws_are_those_of_a_whole_sort(spark):
    from factloom.llm.splitters import draw, keyed
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"))
    rows = keyed(docs, "doc_id", "text")
    total = rows.agg(F.sum("size")).first()[0]
    for count in (10, 500, 5000):
        assert draw(rows, count, total).equals(draw(rows, count, 1)) and len(draw(rows, count, total)) == min(count, 3000)
