import hashlib

import corpus_pipeline as cp
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from pagegraph import session
from pagegraph.llm import quality_rules

from .conftest import data, sentence
from .test_decontaminate import plain as plain_hits
from .test_paragraph_dedup import plain as plain_cut
from .test_simhash import plain_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, near copies, repeated passages, benchmark passages and junk."""
    at = str(tmp_path_factory.mktemp("corpus"))
    passage = sentence(500, 60)
    bench = sentence(600, 40)
    texts = [sentence(i, 80) for i in range(60)]
    texts += [sentence(i, 80) for i in range(5)]  # copies
    texts += [sentence(i, 80) + " x" for i in range(5, 8)]  # near copies
    texts += [sentence(700 + i, 50) + "\n" + passage for i in range(6)]
    texts += [sentence(800 + i, 50) + " " + " ".join(bench.split()[5:30]) for i in range(4)]
    texts += ["## $$ || " * 20, "few words", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(78, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, "other words " * 9)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, [(1, bench), (2, "other words " * 9)]


def test_run_against_brute_force(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = quality_rules.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    good = {r["doc_id"] for r in quality_rules.judge(docs, model).collect() if r["kept"]}
    left = [r for r in rows if r[0] in good]
    tops = {c for _, _, c in plain_classes(left)}
    left = [r for r in left if r[0] in tops]
    cut = dict(plain_cut(left))
    left = [(r[0], cut[r[0]], *r[2:]) for r in left]
    clean = {r[0] for r in plain_hits(left, items) if not r[-1]}
    lib = Library.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in left:
        if r[0] in clean:
            ids = lib.encode(r[1] or "", add_special_tokens=False).ids
            want[r[0]] = (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    out = {r["doc_id"]: (r["n_tokens"], r["ids"], r["ids_sha256"]) for r in cp.run(spark, at).collect()}
    assert out == want
    assert len(tops) < len(good) < len(rows) and len(clean) < len(tops)


def test_stages_return_the_columns_of_documents(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert len(cp.STAGES) == 5
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_empty_documents(spark, folder):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").where("false")
    for name, stage in cp.STAGES:
        assert data(stage(spark, docs, at)) == [], name


def test_whole_small_corpus(spark, small):
    assert 0 < cp.run(spark, small).count() < 200


def test_a_run_goes_on_after_its_last_whole_stage(spark, folder, tmp_path, monkeypatch):
    source, kept = folder[0], f"file://{tmp_path}/run"
    want = sorted(data(cp.run(spark, source).select("doc_id", "ids_sha256")), key=str)
    stages, called = list(cp.STAGES), []

    def noted(k, dies):
        def stage(spark, docs, sf_dir):
            called.append(k)
            out = stages[k][1](spark, docs, sf_dir)
            return out.where(F.raise_error(F.lit("lost")).isNull()) if dies else out

        return stage

    monkeypatch.setattr(cp, "STAGES", [(n, noted(k, k == 2)) for k, (n, _) in enumerate(stages)])
    with pytest.raises(Exception, match="lost"):
        cp.run(spark, source, kept)
    assert called == [0, 1, 2]
    called.clear()
    monkeypatch.setattr(cp, "STAGES", [(n, noted(k, False)) for k, (n, _) in enumerate(stages)])
    assert sorted(data(cp.run(spark, source, kept).select("doc_id", "ids_sha256")), key=str) == want
    assert called == [2, 3, 4]


def test_small_tables_in_many_partitions_get_few_files(spark, tmp_path):
    """Each file of an executor starts processes; texts and words of items had one for each shuffle partition."""
    said = [sentence(s, 70) for s in range(60)]
    rows = [(i, said[i % 60] + "\n" + sentence(1000 + i, 30), "en", "s", 1) for i in range(240)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(f"i{s}", sentence(s, 40)) for s in range(3000, 3240)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = sorted(data(cp.repeated_paragraphs(spark, docs, str(tmp_path))), key=str)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {k: spark.conf.get(k) for k in names}
    known = set(session._STAGED)
    try:
        for k, v in zip(names, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        cut = cp.repeated_paragraphs(spark, docs, str(tmp_path))
        assert sorted(data(cut), key=str) == expected
        assert sum(len(r[1].split()) for r in expected) < sum(len(r[1].split()) for r in rows)
        assert data(cp.benchmark_passages(spark, docs, str(tmp_path)).groupBy().count()) == [(240,)]
        most = session.file_parts(docs)
        assert most < 64
        for at in set(session._STAGED) - known:
            assert len(spark.read.parquet(at).inputFiles()) <= most, at
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
