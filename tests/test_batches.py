"""Slices of Arrow batches hold all rows, and little at a time."""

import pyarrow as pa
import pytest

from tidemark.batches import slices
from tidemark.operators import pageview, passages
from tidemark.sources import decoding, regions


@pytest.mark.parametrize("make", [str, lambda x: str(x).encode()])
def test_slices_hold_all_rows_in_order_and_little_at_a_time(make):
    values = [make("x" * n) for n in (3, 0, 7, 40, 1, 1, 9, 10)] + [None] * 30
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(values))), "v": values})
    found = list(slices(iter([batch, batch.slice(0, 0), batch.slice(2, 5)]), "v", 10))
    assert [v for b in found for v in b["v"].to_pylist()] == values + values[2:7]
    assert all(b.num_rows == 1 or sum(len(v or "") for v in b["v"].to_pylist()) <= 10 for b in found) and len(found) < 14


@pytest.mark.parametrize("operator", [
    lambda d: pageview.page_blocks(d, "k", "v"), lambda d: pageview.isolated_pages(d, "k", "v"), lambda d: passages.source_passages(d, "k", "v"),
    lambda d: passages.links(d, "k", "u", "v"), lambda d: decoding.decoded(d, "k", "b"), lambda d: regions.decoded_regions(d, "k", "b"),
])
def test_operators_pass_on_what_they_have_read_of_a_large_batch(spark, operator):
    """The function an operator gives to Spark, run on one batch of 6 MB, yields before it has read all of it."""

    class Frame:
        schema = {"k": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, shape: run

    text = "<p>some words <a href='http://a.example/x'>link</a> here.</p>\n" * 1000
    columns = {"k": list(range(100)), "v": [text] * 100}
    names = operator.__code__.co_consts
    if "u" in names:
        columns = {"k": columns["k"], "u": ["http://a.example/"] * 100, "v": columns["v"]}
    if "b" in names:
        columns = {"k": columns["k"], "b": [text.encode()] * 100}
    found = list(operator(Frame())(iter([pa.RecordBatch.from_pydict(columns)])))
    assert len(found) >= 6 and set().union(*(b.column(0).to_pylist() for b in found)) == set(range(100))
