"""Tidewire: feed, market-board and story analytics as Spark DataFrame plans."""
