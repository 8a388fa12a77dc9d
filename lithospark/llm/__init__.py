"""Training-data operators: sharding, language ID, mixing, fingerprints, BPE,
substring and near-duplicate removal, URL filters, nearest neighbours and a
quality classifier. Nothing else in the library imports this subpackage.
"""
