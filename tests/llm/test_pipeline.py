"""The pipeline against the operators' brute-force versions, stage by stage."""

import corpus_pipeline
from test_operators import brute_components


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # what isn't English here has few labels: the stages are judged each on its own input
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{d}/{k}")
        after = spark.read.parquet(f"{d}/{k}")
        if k < 4:
            assert after.columns == docs.columns
            ids = {r.doc_id for r in after.collect()}
        if k == 1:
            last = {}
            for r in before:
                last[r.text] = max(last.get(r.text, -1), r.doc_id)
            assert ids == set(last.values())
        elif k == 2:
            comp = brute_components([(r.doc_id, r.text) for r in before], 80, 5)
            assert ids == {i for i, (_, c) in comp.items() if i == c}
        elif k == 3:
            assert ids == {r.doc_id for r in before}
            assert not [r for r in after.collect() if "token = \"" in r.text and "[secret]" not in r.text]
        elif k == 4:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before}
        docs = after


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_stage_edges(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, and columns named like results."""
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (None, "no id"), (5, long), (6, long + " end"), (7, 'token = "abcdefghijklmnop" x')]
    extra = "score double, predicted string, keep_id string, group_size int, kept string, text_sha256 string, secrets string, component_id string, row int, __base int"
    mine = (0.25, "p", "mine", -1, "k", "sha", "s", "c", 9, 8)
    for n_chars in (True, False):
        docs = spark.createDataFrame([(i, t, *([-5] if n_chars else []), *mine) for i, t in rows], "doc_id long, text string, " + ("n_chars int, " if n_chars else "") + extra)
        want = {0: rows, 1: [(2, ""), *rows[3:]], 2: [r for r in rows if r[0] != 6 and r != (4, "same text here")], 3: [*rows[:-1], (7, '[secret]" x')]}
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            if not n_chars and k != 3:
                continue  # only the secret stage looks at n_chars
            out = stage(spark, docs, sf)
            assert stage(spark, docs.where("false"), sf).count() == 0, name
            if k == 4:
                assert sorted({r.doc_id for r in out.collect()}, key=repr) == sorted({i for i, _ in rows}, key=repr)
                continue
            assert out.schema == docs.schema or [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
            got = out.collect()
            assert sorted([(r.doc_id, r.text) for r in got], key=repr) == sorted(want[k], key=repr), name
            assert all(tuple(r)[-len(mine) :] == mine for r in got), name
            if n_chars:
                assert all(r.n_chars == (-5 if k < 3 or "[secret]" not in (r.text or "") else len(r.text)) for r in got)
