import collections

import brute
import pytest

from nearfold.llm import exact_dedup


def check(df, **params):
    rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    got = exact_dedup.exact_dedup(df, **params).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[brute.norm_sha(t)].append((-len(t), d is None, d or 0, d))
    seen = collections.Counter()
    for r in got:
        best = min(groups[r.text_sha256])
        assert (r.keep_id, r.group_size) == (best[3], len(groups[r.text_sha256]))
        seen[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(n == 1 for n in seen.values()) and set(seen) == set(groups)


@pytest.mark.parametrize("bits", [(0, 1), (3, 1), (6, 3), (5, 2)])
def test_equal_to_brute_force_for_any_tree(docs, bits):
    check(docs, run_bits=bits[0], round_bits=bits[1])


def test_odd_rows(odd):
    check(odd.repartition(5))


def test_empty_table(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_no_python_in_the_plan(docs):
    from nearfold.llm.exact_dedup import digests, tree_merge

    plan = tree_merge(digests(docs, 3), 3, 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
