"""leadsieve: qualify very large company lists with Spark DataFrames."""

from leadsieve.config import SieveConfig, load_config
from leadsieve.plans.qualify import qualify

__all__ = ["SieveConfig", "load_config", "qualify"]
