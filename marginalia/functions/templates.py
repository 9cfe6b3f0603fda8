"""Prompt texts and model settings."""

from __future__ import annotations

# Model settings per kind of call (token limit, temperature).
EXTRACT_TOKENS, SEED_TOKENS, REVIEW_TOKENS = 450, 1000, 500
TEMPERATURE = 0.0

EXTRACT_SYSTEM = "You find the functions in source files."
EXTRACT_HEAD = """List every function of the source file below, one per line and nothing else.
A line is {"name", "path", first_line, last_line}; a method is named {"Class:method", ...}.
Use the numbers printed in front of the lines. Count blank and comment lines, but let a function
start and end on a line of code. Example for a file /lib/parser.js:
{"Parser:next", "/lib/parser.js", 12, 40}

File Path: """
EXTRACT_MIDDLE = "\n\nFile Content:\n"

SEED_SYSTEM = "You plan code reviews."
SEED_HEAD = """Below are the functions of a project, one per line as {"name", "path", first_line, last_line}.
Answer with the line of the function that should be reviewed first, unchanged, and nothing else.

Functions:
"""

REVIEW_SYSTEM = "You review source code."
REVIEW_HEAD = """Review the function below for errors, waste and unclear code, as an experienced engineer would.

Function:
"""
REVIEW_PATH = "\n\nFile: "
REVIEW_LIST = "\n\nFunctions not reviewed yet, as path:name:\n"
REVIEW_TAIL = """
Answer with one line in exactly this form, fields separated by two backticks:
{function``severity``review``continue``next function``next path}
severity is 1 (minor), 2 (maintainability) or 3 (serious); the review has no line breaks and at most
200 words; continue is 1 to go on with a function of the list and 0 to stop.
"""
