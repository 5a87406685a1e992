from __future__ import annotations

import random

import numpy as np
import pytest

from quire.llm import shared

from .helpers import closed


def graph(seed: int) -> list[tuple[int, int]]:
    rnd = random.Random(seed)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(5, i) for i in range(2000, 2100)] + [(i, 5) for i in range(2050, 2150)]
    loose = [(rnd.randrange(3000, 3400), rnd.randrange(3000, 3400)) for _ in range(180)]
    edges = chain + star + loose + loose[:20] + [(-7, 9), (9, -(2**40)), (4, 4)]
    rnd.shuffle(edges)
    return edges


@pytest.mark.parametrize("bound", [shared.EDGES, 50, 0])
def test_components(spark, bound):
    edges = graph(bound)
    got = {r.id: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long").repartition(5), bound).collect()}
    linked = [(a, b) for a, b in edges if a != b]
    nodes = sorted({x for e in linked for x in e})
    assert got == closed(nodes, linked)


def test_a_long_ordered_chain_takes_few_rounds(spark, monkeypatch):
    names, n = [], 6000
    keep = shared.stage
    monkeypatch.setattr(shared, "stage", lambda df, name, *more: names.append(name) or keep(df, name, *more))
    edges = spark.range(n, numPartitions=8).selectExpr("id a", "id + 1 b").repartition(8)
    got = shared.components(edges, 100)
    assert got.where("component <> 0").isEmpty() and got.count() == n + 1
    assert names.count("stars") <= 3


def test_no_machine_local_folder_on_a_cluster():
    class Cluster:
        class sparkContext:
            class _jsc:
                @staticmethod
                def sc():
                    return Cluster

        class conf:
            @staticmethod
            def get(*_):
                return None

        @staticmethod
        def getCheckpointDir():
            return Cluster

        @staticmethod
        def isDefined():
            return False

        isLocal = isDefined

    with pytest.raises(ValueError, match="checkpoint"):
        shared.work_dir(Cluster)


def test_no_edges(spark):
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contract_keeps_components_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shared, "EDGES", 16)
    edges = [e for e in graph(3) if e[0] != e[1]]
    batches = [pa.record_batch([pa.array([a for a, _ in edges[i : i + 7]], pa.int64()), pa.array([b for _, b in edges[i : i + 7]], pa.int64())], ["u", "v"]) for i in range(0, len(edges), 7)]
    out = [e for b in shared._contract(iter(batches)) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    nodes = sorted({x for e in edges for x in e})
    assert closed(nodes, out) == closed(nodes, edges) and len(out) <= len(edges)


def test_roots():
    nodes, low = shared.roots(np.array([3, 1, 8], np.int64), np.array([2, 2, 9], np.int64))
    assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
