"""Queries over the driver tables; importing this package fills the registry."""

from tickloom.plans import features, flagship, labels, ledger, mldata, rollups, screen, sources, streams, structure  # noqa: F401
