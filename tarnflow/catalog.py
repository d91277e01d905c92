"""The registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from tarnflow.plans import flow as _flow  # noqa: F401
from tarnflow.plans import forests as _forests  # noqa: F401
from tarnflow.plans import more as _more  # noqa: F401
from tarnflow.plans import runs as _runs  # noqa: F401
from tarnflow.plans import scenes as _scenes  # noqa: F401  registers its queries
from tarnflow.plans import tables as _tables  # noqa: F401
from tarnflow.plans.registry import ORACLES as ORACLES
from tarnflow.plans.registry import QUERIES as QUERIES

FLAGSHIP = "cup_fill"
