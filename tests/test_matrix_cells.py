"""The matrix check covers every cell."""

from binloom.plans import catalog_tables
from binloom.sources.genome import Genome


def test_matrix_check_covers_cells(spark):
    g = Genome(spark, "/root/testdata/sf0.01")
    want = g.read("lineitem").where("l_suppkey % 10 = 3").select("l_suppkey").distinct().count()
    assert want > 3 and [tuple(r) for r in catalog_tables.l2(g).collect()] == [("HA", "barcodes_missing", want)]
