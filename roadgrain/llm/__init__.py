"""Operators for preparing training text: duplicates, privacy, search, tokens, language, toxicity, licences, packing, alignment,
manifests, repetition."""
