"""Operations of a large-scale training-data pipeline, one module each.

Nothing else in the package imports this subpackage.  ``queries`` registers
one query per operator; ``corpus_pipeline.py`` at the repository top chains
five of them.
"""
