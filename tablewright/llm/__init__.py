"""Operators for preparing training corpora: one module for each operator,
``queries.py`` for the registered queries.  Nothing else imports this package."""
