import random

import pytest

import corpus_pipeline
from assaykit.llm import quality
from assaykit.llm.queries import QUERIES

from .test_decontaminate_and_mixing import brute as brute_hits
from .test_pii import brute as brute_spans
from .test_scores import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents, labels and benchmark with planted copies, passages and personal data."""
    root, rng = tmp_path_factory.mktemp("tables"), random.Random(7)
    item = " ".join(f"bench{i}" for i in range(30))
    rows, known = [], []
    for i, text, good, toxic in corpus(260):
        if i % 11 == 0:
            text += " " + item
        if i % 7 == 0:
            text += " reach a.b@mail.example.com now"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        known.append((i, good, toxic))
    for k in range(40):  # exact copies, and copies with a changed word
        text = rows[k][1]
        rows.append((1000 + k, text, "en", "src0", len(text)))
        words = text.split()
        words[rng.randrange(len(words))] = "other"
        rows.append((2000 + k, " ".join(words), "en", "src1", len(text)))
    rows += [(3000, None, None, None, None), (3001, "", "en", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "one_of_each", "uncontaminated", "redacted", "mixed"]

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = corpus_pipeline.good_quality(spark, docs, folder)
    scored = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert kept.columns == names and {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s >= 0.7}
    assert kept.count() < docs.count()

    one = corpus_pipeline.one_of_each(spark, docs, folder)
    ids = {r.doc_id for r in one.collect()}
    assert one.columns == names and not ids & set(range(1000, 1040)) and set(range(260)) <= ids
    by_id = {r.doc_id: r.text for r in docs.collect()}
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    near = [k for k in range(40) if len(a := shingles(by_id[k])) and len(a & (b := shingles(by_id[2000 + k]))) >= 0.8 * len(a | b)]
    assert sum(2000 + k not in ids for k in near) >= 0.9 * len(near)

    clean = corpus_pipeline.uncontaminated(spark, docs, folder)
    hits = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == {i for i, h in hits.items() if not h[4]}

    redacted = corpus_pipeline.redacted(spark, docs, folder)
    assert redacted.columns == names and redacted.count() == docs.count()
    for r in redacted.collect():
        assert not brute_spans(r.text or "") and (r.text is None or r.n_chars == len(r.text))

    mixed = corpus_pipeline.mixed(spark, docs, folder)
    assert all(0 < r.taken <= 3 * r.size for r in mixed.collect())


def test_run_applies_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert got and len(ids) == len(got) and not ids & set(range(1000, 1040))
    assert all("bench5" not in r.text and "@mail" not in r.text for r in got)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11))
