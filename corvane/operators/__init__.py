"""DataFrame operators of the shard-selection engine."""
