"""The classifiers on labelled documents that their training never saw."""

import os

import pytest

from inkfold.llm import quality, toxicity
from inkfold.llm.common import table

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def held_out(spark, query, label):
    """(label, score, predicted) of the labelled documents that were held out."""
    marks = table(spark, DATA, "labels").where(f"{label} is not null").select("doc_id", label).distinct()
    rows = query(spark, DATA).where("held_out").join(marks, "doc_id").select(label, "score", "predicted").collect()
    assert len(rows) > 500 and all(0 <= r["score"] <= 1 for r in rows)
    return [(int(r[label] > 0), r["score"], r["predicted"]) for r in rows]


def curve(rows):
    """Area under the curve: the share of (positive, negative) pairs in the right order, ties as half."""
    yes, no = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))


def test_quality(spark):
    rows = held_out(spark, quality.op2_quality, "quality")
    accuracy, area = sum(y == p for y, _, p in rows) / len(rows), curve(rows)
    print("quality", len(rows), accuracy, area)
    assert accuracy > 0.97 and area > 0.98


def test_toxicity(spark):
    rows = held_out(spark, toxicity.op8_toxicity, "toxic")
    hits, said, real = sum(y and p for y, _, p in rows), sum(p for _, _, p in rows), sum(y for y, _, _ in rows)
    precision, recall, area = hits / said, hits / real, curve(rows)
    print("toxicity", len(rows), real, precision, recall, area)
    assert precision > 0.8 and recall > 0.65 and area > 0.9
