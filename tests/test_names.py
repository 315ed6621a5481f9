"""Names that come from tables that were written out."""

import pytest

from tessera.dataset import CountDataset, checkpoint
from tessera.operators import labels as L
from tessera.operators import model as M
from tessera.operators import raw as R


@pytest.fixture(scope="module")
def steps(spark):
    # gene i is in the first i cells
    rows = [(i, c, 1 + (i * c) % 3) for i in range(1, 11) for c in range(i)]
    return CountDataset.build(spark.createDataFrame(rows, "gene long, cell long, n long"))


def test_names_written_out_with_their_positions(steps):
    """What ``clean`` found is written out with the columns that it came with; these don't meet those of the dataset."""
    few = checkpoint(R.expressing_cells(steps).where("n_cells <= 3"))
    left = R.drop_genes_cells(steps, genes=few)
    assert sorted(r.gene for r in left.genes.collect()) == list(range(4, 11)) == sorted(r.gene for r in left.counts.select("gene").distinct().collect())
    with pytest.raises(ValueError, match="unknown"):
        R.drop_genes_cells(left, genes=few)
    kept = R.clean(steps, cells_cutoff=0.3, genes_cutoff=0.3)
    assert {r.gene for r in kept.genes.collect()} == set(range(4, 11)) and {r.cell for r in kept.cells.collect()} == set(range(8))
    sizes = checkpoint(R.cell_sizes(steps))
    assert M.set_estimate(steps, "nu", sizes.withColumnRenamed("size", "nu")).cells.where("nu > 0").count() == 10
    assert "k" in L.label_names(L.add_labels(steps, "k", sizes.selectExpr("cell", "string(size % 2) AS cluster")))
