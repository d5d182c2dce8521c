"""COBOL programs as plans: source text, statements, and their lowering to DataFrames."""

from .program import Diagnostic, Program, UnsupportedVerbError, run

__all__ = ["Diagnostic", "Program", "UnsupportedVerbError", "run"]
