"""Connected components: rows written over all rounds."""

from tidemark.llm import components as module


def test_later_rounds_touch_only_nodes_that_are_left(spark, monkeypatch):
    """A long chain takes many rounds; finished pairs and merged nodes are not carried through them."""
    written, keep = [], module.stage

    def count(df, name):
        table = keep(df, name)
        if name in ("nodes", "parents"):
            written.append(table.count())
        return table

    monkeypatch.setattr(module, "stage", count)
    n, rounds = 1500, []
    edges = [(i, i + 1) for i in range(n)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(2000)]
    found = module.components(spark.createDataFrame(edges, "u long, v long"), rounds).collect()
    assert {r["node"]: r["root"] for r in found} == {x: 0 if x <= n else x // 2 * 2 for e in edges for x in e}
    assert len(rounds) > 4 and sum(written) < 5 * len(found) + 4 * n
