"""Archive-migration analytics on Spark DataFrames."""

from vaultferry.options import Extensions, MigrationFilters, RunOptions
from vaultferry.session import prepare_session

__all__ = ["Extensions", "MigrationFilters", "RunOptions", "prepare_session"]
