"""Patient-event sequences on Spark: DataFrame operators from raw clinical tables to model rows."""

from medstrand.functions.keyed import keyed_hash, keyed_uniform

__all__ = ["keyed_hash", "keyed_uniform"]
