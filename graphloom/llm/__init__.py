"""Operators for training-data pipelines: licences, scoring, mixing, quality, packing, chat, near copies, HTML.

Nothing else in the library imports this subpackage.
"""
