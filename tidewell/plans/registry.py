"""All queries of the engine by name, each with its SQL where SQL can say it."""

from tidewell.plans import more, oracle, publication, queries, reader, surface

PARTS = (queries, more, reader, publication, surface)
QUERIES = {k: f for m in PARTS for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in (oracle, more, reader, publication, surface) for k, q in m.ORACLE.items()}
flagship = queries.editorial_topn
