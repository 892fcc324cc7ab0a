"""Token, tensor and prefix-reuse analytics expressed as Spark DataFrame plans."""

__version__ = "0.1"
