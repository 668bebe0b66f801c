from foliant.operators import paint


def test_inherits_below_sixty_four_levels(spark):
    nodes = spark.createDataFrame([(1, k, k - 1, "element") for k in range(70)], "doc_id long, node_id int, parent_id int, kind string")
    won = spark.createDataFrame([(1, 0, "color", "#ddeeff")], "doc_id long, node_id int, prop string, value string")
    assert {r.node_id for r in paint.inherited(nodes, won).collect()} == set(range(70))
