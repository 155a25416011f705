"""A Spark-native engine for relative-value and cross-sectional statistical arbitrage: lakes, screens, hedges, signals, ledgers, validation."""

__version__ = "0.1.0"
