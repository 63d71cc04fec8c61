"""The queries over the driver's tables."""

from . import dictionaries, evaluation, files, grading, lexicon, scoring, sequences, words
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "dictionaries", "evaluation", "files", "grading", "lexicon", "scoring", "sequences", "words"]
