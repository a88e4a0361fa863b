"""Texts of projects are put together as their pieces pass, and held once."""

import pyarrow as pa

from stratograph.operators import render
from stratograph.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_pieces_over_batches():
    """A project over three batches, one without a head, one whose head is empty, and one without a name."""
    rows = [[("A", 0, "h"), ("A", 1, "a")], [("A", 1, "é")], [], [("A", 2, "t"), ("B", 1, "lost"), ("C", 0, "")], [("C", 1, "c"), (None, 0, "n")]]
    batches = (pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))], names=["project_id", "part", "text"]) for part in rows)
    found = [tuple(batch[c][0].as_py() for c in ("project_id", "report")) for batch in render._put_together(batches)]
    assert found == [("A", "h\na\né\nt"), ("C", "\nc"), (None, "n")]
    assert list(render._put_together(iter([]))) == []


def test_no_aggregate_holds_the_pieces(spark):
    plan = catalog.QUERIES["str5_graph_text"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("MapInArrow") == 2
    assert render._two_cores(spark.range(1)) is None  # a local session's tasks all count alike
