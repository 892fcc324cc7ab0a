"""Modules and the classifier."""

from pyspark.sql import functions as F

from strataflow.plans import nn


def test_linear_stack(spark):
    net = nn.Sequential(nn.Linear(4, 8), nn.Linear(8, 2))
    x = F.expr("array(0.1f, 0.2f, 0.3f, 0.4f)")
    assert spark.range(1).select(net(x).alias("y")).first()["y"] == [0.0, 0.0]
    assert len(net.parameters()) == 4


def test_classifier_learns(spark):
    got = nn.train_classifier(nn.separable(spark, 512), epochs=8)
    assert got[-1]["loss"] < got[0]["loss"] and got[-1]["accuracy"] > 0.9
