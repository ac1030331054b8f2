from . import engine, measures, queries, requests, shapes, thin, traces  # noqa: F401  (they register their queries)
