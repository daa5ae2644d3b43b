"""All queries of the library proper: name to job, and name to SQL."""

from collections.abc import Callable

from ..operators import bibliography, corpus, folders, inventory, layout, matching, naming, parts, quality, render, tasks, templates
from ..sources import files
from ..streaming import jobs
from . import pipeline

MODULES = [corpus, bibliography, render, parts, matching, naming, tasks, quality, inventory, folders, layout, templates, files, jobs, pipeline]


def queries() -> dict[str, Callable]:
    return {name: job for m in MODULES for name, job in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
