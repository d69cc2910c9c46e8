"""Plans of the engine: importing this package registers all queries."""

from . import aggregating, analysing, basics, compositions, estimating, joining, scalars, shapes, streams, windowing  # noqa: F401
