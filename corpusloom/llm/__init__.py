"""Training-data operators: language id, dedup, filters, scans, packing, WARC and decontamination.

Nothing outside this subpackage imports it; it can be removed without affecting the rest of the library.
"""
