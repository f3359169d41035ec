"""What the driver of the near-duplicate stage and of the pipeline holds: plans and its heap."""

import random
import re

from palimpsest.llm import minhash
from palimpsest.llm.common import Scratch


def test_plans_of_components_stay_small(spark, monkeypatch):
    """A chain takes several rounds; no plan has another round's or that of the edges, and all but the result is dropped."""
    exchanges, cut = [], Scratch.cut

    def watched(self, df, *partition_by):
        exchanges.append(len(re.findall(r"Exchange |InMemoryTableScan", df._jdf.queryExecution().executedPlan().toString())))
        return cut(self, df, *partition_by)

    monkeypatch.setattr(Scratch, "cut", watched)
    order = random.Random(1).sample(range(100, 140), 40)
    rows = [tuple(sorted(x)) for x in zip(order, order[1:])] + [(1, k) for k in range(2, 60)] + [(70, 71)]
    edges = spark.createDataFrame(rows, "a bigint, b bigint").repartition(3).distinct()
    scratch = Scratch(spark, "t")
    roots = minhash.components(edges, scratch)
    got = {r.node: r.root for r in roots.collect()}
    assert got == {k: 100 for k in range(100, 140)} | {k: 1 for k in range(1, 60)} | {70: 70, 71: 70}
    assert len(exchanges) > 5 and max(exchanges) <= 6
    assert [t for t, _ in scratch.written] == [roots] and not scratch.held


def test_garbage_is_not_collected_after_every_short_step(spark, monkeypatch):
    memory = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if not b.getName().endswith(("Young Generation", "Scavenge"))]
    pauses = lambda: sum(b.getCollectionCount() for b in memory)
    scratch = Scratch(spark, "t")

    def asked(seconds: float) -> int:
        monkeypatch.setattr(Scratch, "collects_after", seconds, raising=False)
        before = pauses()
        for _ in range(5):
            scratch.drop(scratch.cut(spark.range(3)))
        return pauses() - before

    assert asked(1e6) <= 1 and asked(0) >= 5
    assert not scratch.written
