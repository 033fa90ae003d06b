"""Operations of a training-data pipeline over ``documents`` and ``embeddings``.

Nothing else in the library imports this subpackage. ``queries`` holds the
registered queries and their SQL; every other module holds one operator.
"""
