"""custlens: wholesale customer analytics expressed as lazy Spark DataFrame plans.

Layout
------
``sources``    scans of the nine source tables (Parquet or JDBC), the fixture
               adapter for the supplied star schema, the persisted fact and sinks.
``functions``  column-expression helpers (strip, tolerant casts, rounding, dates).
``operators``  the fact build, conforming, filters, the customer aggregate and
               the distributed ordering helpers (global rank / prefix sums,
               month spines, histogram bins).
``plans``      one function per report; each takes DataFrames and returns a
               DataFrame.
"""

from custlens.config import Params, ensure_checkpoint_dir

__all__ = ["Params", "ensure_checkpoint_dir"]
