"""Operations of a training-data pipeline over tables of documents.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` binds the operators to the
tables of a data folder.
"""
