"""Training-data operators: tokenising, fingerprints, scoring, packing, deduplication.

Every operator reads only the columns that it names and returns its own columns, so extra columns of any name never
clash. Nothing else in the library imports this subpackage.
"""
