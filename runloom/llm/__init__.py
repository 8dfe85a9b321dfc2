"""Operations of a training-data pipeline, each in a module of its own.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds the
queries of :mod:`runloom.llm.queries` when it is present.
"""
