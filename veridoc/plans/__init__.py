"""Schemas compiled to SQL expressions: verdicts, errors, evaluated keys, typed columns."""
