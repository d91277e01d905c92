"""Training-data operators: secrets, html extraction, quality, decontamination,
personal data, near-duplicates, mixing, toxicity and licences.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
