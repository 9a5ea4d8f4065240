"""clusterloom: embedding clustering analytics as Spark DataFrame jobs.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
small, bounded Python value such as a metric dict). Nothing collects data rows
to the driver; only k-sized or metric-sized results are ever materialised.
"""

from clusterloom.session import build_session, ensure_checkpoint_dir, cut_lineage

__all__ = ["build_session", "ensure_checkpoint_dir", "cut_lineage"]
