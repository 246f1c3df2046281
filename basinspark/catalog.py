"""Every query of the library by name, with the SQL that gives the same rows."""

from .plans import columns, experiments, extensions, metrics, polygons, readers, spatial, streams, timeseries

ALL = [q for m in (metrics, timeseries, columns, spatial, polygons, experiments, streams, readers, extensions) for q in m.QUERIES]
QUERIES = {q.name: q.run for q in ALL}
ORACLE_SQL = {q.name: s for q in ALL if (s := q.oracle())}
FLAGSHIP = "skill_metrics"
