"""All registered queries of the engine itself."""

from treespan.plans import scalar_queries  # noqa: F401
from treespan.plans.registry import QUERIES, SQL  # noqa: F401
from treespan.plans import tree_queries  # noqa: F401
from treespan.plans import force_queries  # noqa: F401
from treespan.plans import exchange_queries, io_queries, map_queries  # noqa: F401
