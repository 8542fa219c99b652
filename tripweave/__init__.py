"""Origin-destination analytics on road networks, written as Spark DataFrame jobs."""

from tripweave.conf import ModelConf
from tripweave.operators.network import Network
from tripweave.plans.model import Model

__all__ = ["Model", "ModelConf", "Network"]
