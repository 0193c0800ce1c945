"""The correlation of degrees by exact sums against its plan."""

import random

import pytest

from sparkweave.model import Graph
from sparkweave.operators import structure


@pytest.mark.parametrize("loops", [[], [("n1", "n1"), ("n4", "n4")]])
def test_degree_correlation(spark, loops):
    rng = random.Random(4)
    graph = Graph.rows(spark, [(f"n{rng.randrange(20)}", f"m{rng.randrange(9)}") for _ in range(60)] + [("n1", "n2")] + loops)
    assert structure.degree_correlation(graph).first()[0] == pytest.approx(structure.assortativity(graph).first()[0], abs=1e-6)


def test_degree_correlation_where_degrees_do_not_vary(spark):
    assert structure.degree_correlation(Graph.rows(spark, [("a", "b"), ("b", "c"), ("a", "c")])).first()[0] is None
    assert structure.degree_correlation(Graph.rows(spark, [])).first()[0] is None
