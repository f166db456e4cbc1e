"""Training samples with many classes."""

import pytest

from twintrack.llm import training


def test_no_class_is_left_out_silently(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, f"c{k}") for k in range(4)], "doc_id long, y string")
    assert {r.y for r in training.sample(docs, labels, 5, 1000, most_classes=4).collect()} == {"c0", "c1", "c2", "c3"}
    with pytest.raises(ValueError, match="more than 3 classes"):
        training.sample(docs, labels, 5, 1000, most_classes=3)
