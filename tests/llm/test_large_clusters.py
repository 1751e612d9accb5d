"""One bucket of very many unlike near copies: exact link counts in memory that goes with its members."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lumengrade.llm import embedding_dedup as ed


def cluster(n, dim=32, spread=0.03, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal(dim)
    v = middle / np.linalg.norm(middle) + spread * rng.standard_normal((n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unit_rows(unit, cell, sides=None):
    n = len(unit)
    order = np.argsort(cell, kind="stable")
    zero = np.zeros(n, np.int32)
    names = ["cell", "lo", "hi", "cid", "side", "n", "unit"]
    cols = [cell[order], zero, zero, order.astype(np.int64), zero, np.ones(n, np.int64), [unit[k].tobytes() for k in order]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def test_links_over_all_tables_are_exact():
    n, tables, projections = 700, 6, 4
    unit = np.concatenate([cluster(n // 2, spread=0.05), cluster(n // 2, spread=0.09, seed=6)])
    marks = ed.cells(unit, tables, projections, ed.WIDTH)
    total, labels = np.zeros(n), np.arange(n)
    forest = ed._Forest(n)
    for k in range(tables):
        t = unit_rows(unit, marks[:, k])
        gain, label = ed.unit_links(t, tables, projections, ed.WIDTH, 0.9)
        cid = t.column("cid").to_numpy()
        total[cid] += gain
        forest.join(cid, cid[label])
    near = (unit @ unit.T >= 0.9) & (marks[:, None, :] == marks[None]).any(2)
    np.fill_diagonal(near, False)
    assert (total == near.sum(1)).all() and total.max() > 100
    reach = np.arange(n)
    while (reach != (lower := np.where(near, reach[None, :], n).min(1, initial=n).clip(max=reach))).any():
        reach = lower
    labels = forest.label
    assert all((labels[i] == labels[j]) == (reach[i] == reach[j]) for i in range(0, n, 7) for j in range(0, n, 11))


def test_memory_of_one_large_bucket():
    n = 6000
    unit = cluster(n)
    same = np.full(n, 1 << 12, np.int64)  # table 0: every pair meets here
    t = unit_rows(unit, same)
    tracemalloc.start()
    gain, label = ed.unit_links(t, 20, 6, ed.WIDTH, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all pairs at once: over 1 GB
    marks = ed.cells(unit, 20, 6, ed.WIDTH)
    some = slice(0, 40)
    first = (marks[some, None, :] == marks[None]).argmax(2) == 0  # forced into one bucket, pairs without a table in common count here too
    assert (gain[some] == ((unit[some] @ unit.T >= 0.9) & first).sum(1) - 1).all()
    assert (label <= np.arange(n)).all() and len(np.unique(label)) < n / 2


def test_members_that_met_before_are_not_compared_again(monkeypatch):
    unit = np.repeat(cluster(3, spread=0.0), 500, 0) + 0.0
    unit = unit + 1e-6 * np.random.default_rng(1).standard_normal(unit.shape)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    marks = ed.cells(unit, 3, 4, ed.WIDTH)
    t = unit_rows(unit, np.full(len(unit), marks[0, 2], np.int64))
    compared = sum(len(x) * len(y) for x, y, _ in ed._blocks(t, marks, t.column("cell").to_numpy()))
    assert compared < 0.1 * len(unit) ** 2
