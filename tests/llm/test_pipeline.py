import hashlib

import numpy as np

import corpus_pipeline
from lectern.llm.queries import oracle_sql, queries

from lectern.llm.secret_scan import redacted

from .conftest import EXTRA, SCHEMA, prose
from .test_bpe import reference
from .test_decontaminate import words
from .test_near_dedup import brute


def test_stages_against_brute_force(spark, tmp_path):
    folder, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()})
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(kept[0]) == {i for i, t in table.items() if t and any(c.isalpha() for c in t)}
    groups = brute([(i, r.text) for i, r in kept[0].items()], 80)
    assert set(kept[1]) == {i for i, (_, root) in groups.items() if i == root}
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    whole = {i for i, r in kept[1].items() if any(b" ".join(v) in b" ".join(words(r.text)) for v in items)}
    assert not whole & set(kept[2]) and len(kept[2]) >= len(kept[1]) - 2 * len(whole) - 2
    assert set(kept[3]) == set(kept[2]) == set(kept[4])
    library = reference()
    for i, r in kept[4].items():
        assert r.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(kept[3][i].text), "<u4").tobytes()).hexdigest()
        assert kept[3][i].n_chars == len(kept[3][i].text)


def test_stages_on_odd_rows(spark, odd, odd_rows, nothing, tmp_path):
    """Nulls in every column, repeated rows and ids, very long texts, clashing names."""
    stages, folder = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"
    key = 'token = "abcdefghijklmnop"'
    more = [(None, None), (30, prose(30, 40) + key), (30, prose(31, 40)), (None, prose(32, 40) + " " + key), (33, prose(30, 40) + key), (34, "")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, None, None, None, *[None] * len(EXTRA)) for i, t in more], SCHEMA))
    rows = odd_rows + more
    order = lambda pairs: sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1] or ""))
    texts = lambda frame: order((r.doc_id, r.text) for r in frame.collect())
    known = stages["language_id"](spark, docs, folder)
    assert known.columns == docs.columns and texts(known) == order((i, t) for i, t in rows if t and any(c.isalpha() for c in t))
    assert all(r.lang in ("xx", "yy") for r in known.collect())
    one = stages["near_dedup"](spark, docs, folder)
    groups = brute([(i, t) for i, t in rows if i is not None and not (i == 30 and t == prose(31, 40))], 80)
    want = [(i, t) for i, t in dict.fromkeys(rows) if i is None or (groups[i][1] == i and i != 30)]
    want += [(30, min(prose(30, 40) + key, prose(31, 40)))]
    assert one.columns == docs.columns and texts(one) == order(want)
    clean = stages["decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and texts(clean) == order(rows)
    safe = stages["secret_scan"](spark, docs, folder)
    assert safe.columns == docs.columns and texts(safe) == order((i, t and redacted(t)) for i, t in rows)
    library = reference()
    got = stages["byte_bpe"](spark, docs, folder).collect()
    digest = lambda t: hashlib.sha256(np.array(library.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()
    assert order((r.doc_id, r.ids_sha256) for r in got) == order((i, digest(t)) for i, t in rows)
    for name, stage in stages.items():
        assert stage(spark, nothing, folder).count() == 0, name


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert corpus_pipeline.ORACLE_SQL is None
    assert set(oracle_sql()) <= set(queries()) and len(queries()) == 14  # thirteen operators and the pipeline


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
