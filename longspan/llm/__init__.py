"""Operations of a large training-data pipeline over document tables.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` registers the thin per-operator queries and their SQL.
"""
