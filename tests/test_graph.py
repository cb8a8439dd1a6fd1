from tessera.operators import graph


def test_components_of_an_adverse_chain(spark):
    """0, n, n - 1, ..., 1: the smallest label needs a round for each node where it goes one hop a round."""
    n = 150
    chain = [0, *range(n, 0, -1)]
    edges = [*zip(chain, chain[1:]), (900, 800), (800, 900), (700, 700), (None, 5), (6, None)]
    got = sorted(map(tuple, graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == [*((i, 0) for i in range(n + 1)), (700, 700), (800, 800), (900, 800)]
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
