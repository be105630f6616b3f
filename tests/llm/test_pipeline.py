import collections
import hashlib
import math

import pytest
import tiktoken

import corpus_pipeline
from cytoloom.llm import bpe, mixing, quality_classifier
from cytoloom.llm.common import HEAVY_SHARE, lookup

from .helpers import DOCS, EDGE
from .helpers import docs as helper_docs
from .test_dedup import lowered
from .test_text import labelled, slow_mix, slow_quality


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels = labelled(spark, 300)
    rows += [(1000 + i, rows[0][1].title() if i % 2 else rows[0][1]) for i in range(40)]
    rows += [(2000, " ".join([rows[3][1]] * 9)), (2001, " ".join([rows[3][1]] * 9) + " end")]
    table = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{at}/documents.parquet")
    labels.write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_keep_their_promises(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, corpus).cache()
        assert docs.columns == columns, name
        seen.append({r.doc_id: r for r in docs.collect()})
    good, exact, near, mix = seen
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    assert sum(quality[i] for i in good if i in quality) >= 0.97 * sum(quality.values())
    assert sum(1 - quality[i] for i in good if i in quality) <= 0.1 * sum(1 - q for q in quality.values())
    assert set(exact) == {max(i for i in good if lowered(good[i].text) == lowered(good[j].text)) for j in good}
    from .test_dedup import classes, slow_fingerprint

    ids = sorted(exact)
    own = classes([slow_fingerprint(exact[i].text) for i in ids])
    assert set(near) == {min(i for i, c in zip(ids, own, strict=True) if c == k) for k in set(own)}
    assert set(mix) <= set(near)
    counts = collections.Counter(r.doc_id for r in docs.collect())
    weighed = [(i, r.text, "en", r.source) for i, r in near.items()]
    words = {i: len(r.text.split()) for i, r in near.items()}
    assert {i: n * words[i] for i, n in counts.items()} == {i: n for i, n in slow_mix(weighed, 1 << 40, 7, spark).items() if n}
    scorer = quality_classifier.train(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    assert set(good) == {i for i, t in texts.items() if 1 / (1 + math.exp(-slow_quality(scorer, t))) >= 0.3}
    path, pattern = bpe.default_vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    tokens = collections.Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.STAGES[4][1](spark, docs, corpus).collect())
    assert tokens == collections.Counter({(i, len(own.encode_ordinary(near[i].text)), hashlib.sha256(near[i].text.encode()).hexdigest()): n for i, n in counts.items()})


@pytest.mark.parametrize("rows", [[], EDGE, [(None, "a text without an id " * 30)] * 3 + [(None, None), (1, "A text " * 40), (1, "A text " * 40), (1, "another text " * 40)]])
@pytest.mark.parametrize("labelled_rows", [[], [(1, 1, 0), (None, 1, 1), (2, None, None)]])
def test_stages_take_edge_cases(spark, tmp_path, rows, labelled_rows):
    """Nulls anywhere, empty and long texts, repeated rows, empty tables and labels, further columns."""
    given = helper_docs(spark, rows) if rows else spark.createDataFrame([], DOCS)
    spark.createDataFrame(labelled_rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, columns = given, given.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, now, str(tmp_path))
        assert number == 4 or found.columns == columns
        found.write.parquet(f"{tmp_path}/{number}")
        now = spark.read.parquet(f"{tmp_path}/{number}")
        if number in (1, 2):
            texts = [lowered(r.text) for r in now.collect()]
            assert len(texts) == len(set(texts))
    assert now.count() >= (1 if rows else 0)


def test_whole_run_counts_the_mix(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, corpus)
    plan = mixing.mix(docs, block_words=0)
    out = corpus_pipeline.run(spark, corpus)
    assert out.count() == plan.draws.count() and "n_tokens" in out.columns
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_lookup_splits_heavy_keys(spark):
    rows = spark.createDataFrame([(7, i) for i in range(3000)] + [(i, i) for i in range(100, 200)], "k long, v long")
    dim = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = lookup(rows, dim, ["k"], "n")
    assert got.count() == 3100 and got.filter("n IS NULL").count() == 0 and got.filter("n = 3000").count() == 3000
    assert 0 < HEAVY_SHARE < 1
