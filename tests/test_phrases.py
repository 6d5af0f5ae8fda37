"""Phrases are counted by page, in tasks that grow in number with the text."""

import re

import oracle
import pytest

from tidemark.operators import phrases as P
from tidemark.plans import registry

PLAN, SQL = registry.queries()["c13_bigrams"], registry.oracle_sql()["c13_bigrams"]


@pytest.fixture
def texts(spark, tmp_path):
    """Pages of which some have several rows, no id, no text or no two words."""
    rows = [(k, "a b c a b") for k in range(4)] + [(3, "a b x y")] * 2 + [(None, "x y")] * 5 + [(k, "x y z") for k in range(20, 24)]
    rows += [(40, None), (41, ""), (42, "one"), (43, "; -")] + [(k, "Y, z!") for k in range(30, 60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    folder = tmp_path / "one"
    folder.mkdir()
    spark.read.parquet(str(tmp_path / "documents.parquet")).toPandas().astype({"doc_id": "Int64"}).to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("task", [2, 30, 1 << 22])
def test_a_page_is_counted_once_whatever_its_rows(spark, texts, monkeypatch, task):
    monkeypatch.setattr(P, "TASK", task)
    assert oracle.compare(spark, PLAN, SQL, texts) == ""


def test_tasks_grow_in_number_with_the_text(spark, texts, monkeypatch):
    """The words are found once and dealt before any phrase is counted, and the phrases after it."""
    monkeypatch.setattr(P, "TASK", 2)
    plan = PLAN(spark, texts)._jdf.queryExecution().executedPlan().toString()
    assert [int(k) for k in re.findall(r"Exchange .*?(\d+)\), REPARTITION_BY_NUM", plan)] == [31, 81]  # 241 characters, 8 and 3 a task
    assert plan.count("Exchange ") == 2 and plan.count("regexp_extract_all") == 1
    assert "Aggregate" not in plan.split("Exchange ")[-1]
