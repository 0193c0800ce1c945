"""The refusals of operators."""


class GraphError(Exception):
    """Any refusal of this engine."""


class Invalid(GraphError):
    """An argument or a graph that the operator is not defined on."""


class Missing(GraphError):
    """A named node or edge is not in the graph."""


class Unreachable(GraphError):
    """No route joins the named nodes."""


class Cyclic(GraphError):
    """The operator needs a graph without directed cycles."""


class Negative(GraphError):
    """A negative weight or a negative cycle where none may be."""
