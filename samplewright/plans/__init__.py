"""Registered queries over the driver's tables and their SQL."""

from . import modelling, preparing, reporting, selecting, storing

_MODULES = (preparing, selecting, modelling, reporting, storing)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
flagship = selecting.flagship
