"""somnolyt: Spark-native cohort analytics (profile, clean, encode, balance,
train, evaluate and score) built from DataFrame / SQL / Spark ML operators."""

__version__ = "0.1.0"
