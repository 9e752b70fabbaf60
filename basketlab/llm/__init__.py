"""Operators for a large training-data pipeline (decontamination, quality, dedup,
mixing, licences, WARC, language). Nothing outside this folder imports it."""
