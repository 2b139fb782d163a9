"""stratum: analytics tables on Spark -- model graphs, incremental loads,
SCD2 snapshots, schema evolution, layout and data movement, all as
DataFrame -> DataFrame operations."""

from stratum.plans.project import Context, ModelConfig, Project, ProjectError
from stratum.plans.snapshots import SnapshotTable
from stratum.plans.store import TableStore
from stratum.session import get_spark, shared_dir
from stratum.types import Field

__all__ = ["Context", "Field", "ModelConfig", "Project", "ProjectError", "SnapshotTable",
           "TableStore", "get_spark", "shared_dir"]
__version__ = "0.1.0"
