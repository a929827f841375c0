"""Alignment analytics and preparation of training text on Spark."""

from readloom import functions, operators, sources
from readloom.dataset import AlignmentDataset
from readloom.model import FLAGS, STORAGE_FLAGS, AlignmentError, ArgumentError, MalformedInputError, UnsupportedError

__all__ = ["FLAGS", "STORAGE_FLAGS", "AlignmentDataset", "AlignmentError", "ArgumentError", "MalformedInputError", "UnsupportedError", "functions", "operators", "sources"]
