"""The queries: importing the package registers those of all its modules in ``catalogue``."""

from ontospark.plans import catalogue, subsumption  # noqa: F401
