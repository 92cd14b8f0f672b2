"""Training-data operators: archives, token counts, decontamination, quality, packing, URL rules,
secret scans, near-duplicates, fingerprints and language identification.

Nothing else in the library imports this subpackage.
"""
