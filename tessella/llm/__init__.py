"""Training-data pipeline operators: quality, secrets, near-duplicates, URLs, mixing, media, personal data, licences, BPE, top-k, nearest neighbours, variants, manifests.

Nothing outside this subpackage imports it.
"""
