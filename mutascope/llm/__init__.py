"""Training-data operators: quality, near-duplicates, decontamination, PII, licences, secrets,
language-model scores, page text, URL filters and BPE coding.

Nothing else in the library imports this package. ``queries.QUERIES`` and ``queries.ORACLES``
are picked up by ``__spark_entry__`` when the package can be imported.
"""
