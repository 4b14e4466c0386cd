from .star import star_graph
from .store import drop_old, generations, load, save, summary

__all__ = ["drop_old", "generations", "load", "save", "star_graph", "summary"]
