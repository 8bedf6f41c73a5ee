import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from residuum.llm.common import Staged  # noqa: E402

from .test_near_dedup import brute as near  # noqa: E402
from .test_packing import check_pieces  # noqa: E402
from .test_quality import verdicts  # noqa: E402
from .test_secrets import ASSIGN  # noqa: E402


def test_stages_match_brute_force(spark, docs):
    staged = Staged(spark, "test")
    frame = staged.write(docs)
    rows = {r.doc_id: r.text for r in frame.collect()}
    for name, stage in corpus_pipeline.STAGES:
        result = staged.write(stage(spark, frame, ""))
        if name == "packing":
            check_pieces(result.collect(), sorted(rows.items()), 2048)
            break
        assert result.columns == docs.columns
        after = {r.doc_id: r.text for r in result.collect()}
        if name == "quality_rules":
            given = [(r.doc_id, r.text, r.source) for r in frame.collect()]
            assert set(after) == {i for (i, _, _), kept in zip(given, verdicts(given)) if kept}
        elif name == "exact_dedup":
            first = {}
            for i in sorted(rows):
                first.setdefault(rows[i], i)
            assert after == {i: rows[i] for i in first.values()}
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, _, kept) in near(sorted(rows.items()), 5, 80).items() if kept}
        elif name == "secret_scan":
            assert set(after) == set(rows)
            assert not any(len(m[2]) >= 6 for t in after.values() for m in ASSIGN.finditer(t))
            assert not any(re.search(r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", t) for t in after.values())
            assert all(after[i] == rows[i] for i in rows if "[SECRET]" not in after[i])
        frame, rows = result, after


def test_run(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_odd_tables(spark, tmp_path, nothing, odd, docs):
    """No rows, rows without identifiers, and rows that are all alike."""
    same = docs.orderBy("doc_id").limit(1)
    many = same.unionByName(same).unionByName(same)
    for n, (frame, most) in enumerate(((nothing, 0), (odd, 3), (many, 1))):
        frame.write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / f"{n}"))
        assert out.select("doc_id").distinct().count() <= most


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} <= {re.match(r"op\d+_", x)[0] for x in names if x.startswith("op")}
    assert "pipeline" in names
