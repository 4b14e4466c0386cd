from .keys import edge_key, identifier
from .scalars import SCALAR, compare, passes, scalar

__all__ = ["SCALAR", "compare", "edge_key", "identifier", "passes", "scalar"]
