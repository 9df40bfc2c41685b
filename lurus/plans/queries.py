"""All core queries and their SQL."""

from lurus.plans import corpus, evaluation, nested

QUERIES = evaluation.query.queries | corpus.query.queries | nested.query.queries
SQL = evaluation.query.sql | corpus.query.sql | nested.query.sql
