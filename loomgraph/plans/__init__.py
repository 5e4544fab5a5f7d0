"""All queries by name and, where SQL can express them, the SQL that gives the same rows."""

from . import general, more, reference

QUERIES = {**general.QUERIES, **reference.QUERIES, **more.QUERIES}
ORACLE = {**general.ORACLE, **reference.ORACLE, **more.ORACLE}
