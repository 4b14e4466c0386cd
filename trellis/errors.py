"""Typed errors of graph operations."""

from __future__ import annotations


class GraphError(Exception):
    code = "invalidArgument"


class NotFound(GraphError):
    code = "notFound"


class InvalidArgument(GraphError):
    code = "invalidArgument"


class LimitExceeded(GraphError):
    code = "limitExceeded"


class Conflict(GraphError):
    code = "conflict"


class CorruptData(GraphError):
    code = "corruptData"


class UnsupportedVersion(GraphError):
    code = "unsupportedVersion"


class Closed(GraphError):
    code = "closed"
