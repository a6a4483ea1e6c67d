"""Each stage of the pipeline against a plain version, on all that its predecessor kept."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import labelled, queries
from pagemill.llm.labelled import fold
from pagemill.llm.quality import learn
from tests.llm.test_corpus_operators import SCHEMA, awkward, brute_classes, brute_contained, library, water_fill, words


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows that each stage read, and those that it returned."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        got = spark.read.parquet(path)
        out[name] = docs, got
        docs = got
    return out


def test_names_and_columns(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "source_mix", "token_files"]
    assert all(got.columns == columns for name, (_, got) in stages.items() if name != "token_files")


def test_quality(stages, spark, sf):
    given, got = stages["quality"]
    model = learn(given, spark.read.parquet(f"{sf}/labels.parquet"), "quality", fold(3) != 1)
    want = sorted(r.doc_id for r in given.collect() if model.score(np.array([model.measures((r.text or "").encode())]))[0] >= 0.5)
    assert sorted(r.doc_id for r in got.collect()) == want and 0 < len(want) < given.count()


def test_near_duplicates(stages):
    given, got = stages["near_duplicates"]
    classes = brute_classes([(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()], 5)
    want = sorted(i for i, n, c in classes if i == c)
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < given.count()


def test_decontamination(stages, spark, sf):
    given, got = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, *_ in brute_contained([(r.doc_id, r.text) for r in given.collect()], items)}
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in given.collect()} - bad


def test_source_mix(stages):
    given, got = stages["source_mix"]
    rows = [(r.doc_id, r.source, size(r.text), int(hashlib.md5(f"{r.doc_id}\x1f{r.text or ''}".encode()).hexdigest()[:15], 16)) for r in given.collect()]
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    want = {}
    for s in sizes:
        whole = int(target[s] // sizes[s])
        left = target[s] - whole * sizes[s]
        for i, _, n, _ in sorted((r for r in rows if r[1] == s and r[2]), key=lambda r: r[3]):
            more = left >= n or 2 * left >= n and left > 0
            left = left - n if left >= n else -1
            want[i] = whole + more
    copies = collections.Counter(r.doc_id for r in got.collect())
    assert copies == collections.Counter({i: c for i, c in want.items() if c})


def test_token_files(stages):
    given, got = stages["token_files"]
    rows = sorted(got.collect(), key=lambda r: r.start)
    texts = sorted((r.doc_id, r.text) for r in given.collect())
    at = 0
    for r, (i, _), ids in zip(rows, texts, library([t for _, t in texts]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes()))
        at += len(ids) + 1


CLASHES = {"size": "size", "score": "score", "node": "doc", "root": "copies"}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows_with_clashing_columns(spark, sf, name, stage):
    """Nulls, empty and long texts, repeats and ties; columns with the names that the operators themselves use."""
    odd = spark.createDataFrame(awkward(), SCHEMA).withColumnsRenamed(CLASHES).withColumn("taken", labelled.F.lit("kept"))
    got, none = stage(spark, odd, sf), stage(spark, odd.limit(0), sf)
    assert none.count() == 0
    if name == "token_files":
        assert got.count() == len(awkward())
        return
    assert got.schema.fieldNames() == odd.columns and none.columns == odd.columns
    rows = collections.Counter(map(tuple, got.collect()))
    given = collections.Counter((*r, "kept") for r in awkward())
    assert rows and set(rows) <= set(given)
    if name != "source_mix":
        assert all(n <= given[r] for r, n in rows.items())
    if name == "near_duplicates":
        assert {r[1] for r in given} == {r[1] for r in rows} | {awkward()[i][1] for i in (6, 7)} and max(n for r, n in rows.items() if r[0] is not None) == 1
    if name == "decontamination":
        assert rows == given
    if name == "source_mix":
        assert all(rows[r] <= 3 * given[r] for r in rows) and not any(size(r[1]) == 0 for r in rows)


def test_run_gives_the_last_stage(stages, spark, sf):
    key = lambda r: (r.start, r.doc_id)
    want = [(r.doc_id, r.start, r.ids_crc32) for r in sorted(stages["token_files"][1].collect(), key=key)]
    assert [(r.doc_id, r.start, r.ids_crc32) for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=key)] == want


def test_token_query_covers_all_documents(spark, sf):
    got = queries.op2_token_files(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and words("A b") == ["a", "b"]
