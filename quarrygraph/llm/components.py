"""Connected components of a link table, without collecting links or components anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quarrygraph.plans.graph import connected


class Labels:
    """Groups of the rows of one block, and the few links between their ids that connect them (never all pairs)."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = np.asarray(ids, np.int64)
        _, self.label = np.unique(self.ids, return_inverse=True)
        self.edges: list[tuple[int, int]] = []

    def join(self, u: int, others: np.ndarray) -> None:
        """Row u is linked with the rows others."""
        labels, first = np.unique(self.label[others], return_index=True)
        mine = self.label[u]
        new = labels != mine
        if new.any():
            self.edges += [(int(self.ids[u]), int(self.ids[others[k]])) for k in first[new]]
            self.label[np.isin(self.label, labels)] = mine


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for each id that has a link to another; component_id is the least id reachable."""
    return connected(links, a, b).withColumnRenamed("component", "component_id")
