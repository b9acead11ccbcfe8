"""Training-data operators: token files, mixing, dedup, scoring, filtering.

Nothing outside this subpackage imports it.  Each operator module has a
general DataFrame interface; ``registry`` holds the thin ``opN_*`` queries.
"""
