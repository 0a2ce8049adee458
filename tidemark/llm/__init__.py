"""Training-data operators: fingerprints, language, pieces, page text, near-duplicates, decontamination and classifiers.

Nothing outside this subpackage imports it.  Each module holds one operator; ``queries`` registers them.
"""
