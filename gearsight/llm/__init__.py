"""Training-data operators: near-duplicate search, repeated-text removal,
decontamination, URL and quality filters, language-model scores, packing.

Nothing outside this package imports it; ``queries.py`` lists its queries.
"""
