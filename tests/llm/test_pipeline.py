"""The pipeline, stage by stage, and the registration of the queries."""

import hashlib
import subprocess
import sys

import corpus_pipeline as C
import numpy as np
import public_tokenizers as P
import tiktoken
from llm_cases import ROWS, empty, odd
from test_near_duplicates import brute
from test_tiling import brute_cover

from taxomatch.llm import byte_bpe, pii, queries, tiling
from taxomatch.session import scratch_path

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = E.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)
    assert [k for k, _ in C.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination",
                                        "PII", "byte-level BPE"]


def test_stages_on_their_own_input(spark):
    """Each stage against a plain version of itself on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {r.doc_id: r for r in docs.collect()}

    kept = C.quality_stage(spark, docs, SF)
    assert kept.columns == columns
    rows = {r.doc_id: r for r in kept.collect()}
    scores = {r.doc_id: r.predicted for r in queries.op1_quality_model(spark, SF).collect()}
    assert set(rows) == {i for i, p in scores.items() if p}
    assert all(rows[i] == seen[i] for i in rows)

    kept = C.near_duplicate_stage(spark, kept, SF)
    assert kept.columns == columns
    want = brute([(i, r.text) for i, r in rows.items()], C.NEAR)
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {i for i, (_, _, k) in want.items() if k} and all(rows[i] == seen[i] for i in rows)

    kept = C.decontamination_stage(spark, kept, SF)
    assert kept.columns == columns
    items = [tiling.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in rows.items()
             if not any(len(w) >= 5 and brute_cover(w, tiling.tokens(r.text)) >= 0.8 * len(w) for w in items)}
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == clean and len(clean) < len(want)

    kept = C.pii_stage(spark, kept, SF)
    assert kept.columns == columns
    find, changed = pii.Finder(), 0
    for r in kept.collect():
        text = pii.redacted(rows[r.doc_id].text, find.spans(rows[r.doc_id].text))
        changed += text != rows[r.doc_id].text
        assert r.text == text and r.n_chars == len(text) and not find.spans(text)
        rows[r.doc_id] = r
    assert changed

    ranks = byte_bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken")).rank
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in C.bpe_stage(spark, kept, SF).collect()}
    assert set(out) == set(rows)
    for i, r in out.items():
        ids = library.encode_ordinary(rows[i].text)
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    whole = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert whole == out


def test_odd_documents_in_every_stage(spark):
    for df, n in ((odd(spark), len(ROWS)), (empty(spark), 0)):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            assert out.count() <= n
        assert C.bpe_stage(spark, df, SF).count() == n


def test_empty_tables(spark):
    path = scratch_path(spark, f"empty-{np.random.default_rng().integers(1 << 40)}")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    assert C.run(spark, path).count() == 0
    for name, query in queries.QUERIES.items():
        if not name.startswith("op9"):
            assert query(spark, path).count() == 0, name


def test_entry_works_without_the_package():
    code = ("import sys; sys.modules['taxomatch.llm'] = None; sys.modules['corpus_pipeline'] = None; "
            "import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) >= 48 and not any(k.startswith('op') or k == 'pipeline' for k in q); print('fine')")
    r = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                       cwd=C.__file__.rpartition("/")[0])
    assert r.stdout.strip() == "fine", r.stderr
