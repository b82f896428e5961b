"""Operations of a large-scale training-data pipeline.

Each module holds one operator with its own interface; ``queries`` registers
one query per operator over the given tables.
"""
