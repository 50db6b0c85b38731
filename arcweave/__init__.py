"""arcweave: graph analytics over DataFrames."""

from arcweave import experimental
from arcweave.operators.graph import Graph
from arcweave.operators.rank import pagerank, ppr_topk
from arcweave.operators.traverse import bfs, k_hop
from arcweave.plans.runtime import last_run_info, set_execution

__version__ = "0.1.0"
__all__ = ["Graph", "bfs", "experimental", "k_hop", "last_run_info", "pagerank", "ppr_topk", "set_execution"]
