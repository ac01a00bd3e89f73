"""tabtwin: make and judge synthetic versions of a table, Spark-first.

Every operator takes and returns Spark DataFrames. Sub-packages:

- ``functions``  column-expression helpers (portable hash uniforms, bins, distances)
- ``sources``    readers, writers, upserts and the fixture views over the driver tables
- ``operators``  contracts, profiles, splits, fidelity / utility / privacy metrics, generators
- ``plans``      end-to-end jobs (prepare, evaluate)
- ``streaming``  (the reference has no stream processing; see its module docstring)
"""

from tabtwin.spec import ColumnSpec, RoleSpec, SplitSpec

__all__ = ["ColumnSpec", "RoleSpec", "SplitSpec"]
