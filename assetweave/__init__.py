"""Asset-snapshot consolidation, platform roll-ups and call-log health as Spark jobs."""
