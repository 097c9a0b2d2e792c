"""The registered queries; importing this package fills the registry."""

from assetweave.plans import assets, classes, log, platform_queries, snapshots, streams, viewing

__all__ = ["assets", "classes", "log", "platform_queries", "snapshots", "streams", "viewing"]
