from nearfold.operators import ground_truth as GT
from nearfold.operators import knn
from nearfold.plans.splits import INSERT_ID_OFFSET, splits
from nearfold.session import scratch_path


def test_growing_truth_scans_new_slabs_only(spark, monkeypatch):
    sp = splits(spark, "/root/testdata/sf0.001")
    cps = sp.checkpoints
    path = scratch_path(spark, "test_truth")
    scanned = []
    join = knn.knn_join
    monkeypatch.setattr(knn, "knn_join", lambda items, *a, **k: scanned.append(items.count()) or join(items, *a, **k))

    def run(some, **more):
        out = GT.growing_ground_truth(sp.base, sp.inserts, sp.queries, some, sp.n_base, INSERT_ID_OFFSET, 10, **more)
        return sorted(map(tuple, out.collect()))

    first = run(cps[:2], path=path)
    second = run(cps, path=path)
    again = run(cps, path=path)
    assert scanned == [sp.n_base + cps[1], cps[-1] - cps[1]]  # the second run reads the new slabs, the third none
    whole = run(cps)  # one scan, nothing stored
    assert second == again == whole
    assert first == [r for r in whole if r[1] in (0, *cps[:2])]
