from . import endpoints, evaluation, fleet, guarded, ingest, reports, search, stateful, streams, ways  # noqa: F401  # each adds its queries
