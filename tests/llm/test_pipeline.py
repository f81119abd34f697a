"""The corpus pipeline: each stage acts on what the one before kept."""

import corpus_pipeline as cp


def test_stages(spark, sf_dir):
    assert [f.__name__ for _, f in cp.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encoding"]
    docs = cp.table(spark, sf_dir, "documents").cache()
    sizes, at = [docs.count()], docs
    for _, stage in cp.STAGES[:-1]:
        at = stage(spark, at, sf_dir).cache()
        assert at.columns == cp.COLUMNS
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert not at.where("n_chars <> char_length(text)").count()
    out = cp.run(spark, sf_dir)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in at.select("doc_id").collect())
    assert "ids" in out.columns


def test_stages_take_odd_rows(spark, sf_dir):
    text = "Some words that make a line of a good length for all the rules here"
    rows = [(1, text, None, "s", 1), (1, text, None, "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, text + " too", "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (docs, docs.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
        assert cp.encoding(spark, docs, sf_dir).count() <= 3


def test_near_dedup_links_from_080(spark, sf_dir):
    rows = []
    for g in range(40):  # of 100 shingles two changed words spoil ten: 90 / 110, three fifteen: 85 / 115
        words = [f"g{g}w{k}" for k in range(104)]
        two, three = list(words), list(words)
        for k in (30, 60):
            two[k] += "x"
        for k in (20, 50, 80):
            three[k] += "y"
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(two)), (1000 + g, " ".join(f"t{w}" for w in three))]
        rows += [(2000 + g, " ".join(f"t{w}" for w in words))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in cp.near_dedup(spark, docs, sf_dir).collect()}
    assert kept == {3 * g for g in range(40)} | {k for g in range(40) for k in (1000 + g, 2000 + g)}  # 0.818 goes, 0.739 stays


def test_quality_takes_frequent_lines_out(spark, sf_dir):
    own = " ".join(f"w{k}" for k in range(12))
    rows = [(k, f"Home\n{own} number {k}\n  READ   more", "s") for k in range(30)]
    rows += [(100, rows[0][1], "s"), (101, f"Home\n{own} elsewhere", "t"), (102, "Home\nfew words", "s"), (None, f"{own} here\nhome\n", "s"), (None, None, "s")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.quality(spark, docs, sf_dir)
    assert not got.where("n_chars <> char_length(text)").count()
    want = [(0, rows[0][1]), (100, rows[0][1]), (101, rows[31][1]), (None, f"{own} here\n")] + [(k, f"{own} number {k}") for k in range(1, 30)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_line_dedup_of_short_lines(spark, sf_dir):
    rows = [(1, "Read more\nalpha beta gamma delta\nMenu\nred blue"), (2, "own words of two\nread  MORE\nalpha beta other delta\nmenu\n\nred green"),
            (3, "own\nalpha beta delta")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.line_dedup(spark, docs, sf_dir).collect()}
    two = "own words of two\n\nred green"
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (two, len(two)), 3: (rows[2][1], len(rows[2][1]))}  # under 4 words only equal lines go


def test_each_text_has_its_own_verdict(spark, sf_dir):
    def clean(name):
        return " ".join(f"{name}{k}" for k in range(40))

    leak = max((r.text for r in cp.table(spark, sf_dir, "benchmark").collect()), key=len)
    rows = [(None, clean("a")), (None, leak), (None, "short"), (7, clean("b")), (7, leak), (7, "short"), (3, clean("c")), (9, clean("c")), (9, clean("d"))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for stage, gone in ((cp.quality, {2, 5}), (cp.near_dedup, {7}), (cp.decontamination, {1, 4})):
        got = sorted(((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).collect()), key=str)
        assert got == sorted((r for k, r in enumerate(rows) if k not in gone), key=str), stage
