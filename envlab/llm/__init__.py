"""Operators for preparing training text: one module per operator, their registered queries in
``queries.py`` and the SQL twins in ``oracle.py``. Nothing else in the library imports this package."""
