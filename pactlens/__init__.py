"""Contract-risk analytics on Spark DataFrames."""

from pactlens.config import CascadeConfig, Lexicon

__all__ = ["CascadeConfig", "Lexicon"]
