import hashlib
from collections import defaultdict

import pytest

from residuum.llm.exact_dedup import deduplicate, duplicate_groups


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_match_brute_force(docs, corpus, keep):
    groups = defaultdict(list)
    for i, text, *_ in corpus:
        groups[text or ""].append(i)
    pick = max if keep == "largest" else min
    expected = {
        (i, pick(ids), len(ids), i == pick(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items()
        for i in ids
    }
    assert {tuple(r) for r in duplicate_groups(docs, keep=keep).collect()} == expected


def test_deduplicate_keeps_rows_and_columns(docs, corpus):
    kept = deduplicate(docs)
    assert kept.columns == docs.columns
    first = {}
    for i, text, *_ in corpus:
        first.setdefault(text or "", i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_odd_rows(odd, nothing):
    rows = duplicate_groups(odd, keep="largest").collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 3
    assert {r.group_size for r in rows if r.doc_id == 4} == {3}
    assert deduplicate(odd).count() == 3
    assert duplicate_groups(nothing).count() == 0 and deduplicate(nothing).count() == 0
    with pytest.raises(ValueError):
        duplicate_groups(odd, keep="any")
